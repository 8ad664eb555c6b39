"""Retrieve and rank: terms, postings, frequencies, features, order, cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import bm25_term, five_numbers, idf
from ..functions.text import tokenize, url_length, url_slashes
from ..schemas import FEATURES, KIND, TOP
from ..sources.corpus import Corpus
from ..sources.files import written


def with_terms(queries: DataFrame) -> DataFrame:
    """query_id and terms (in order, repeats kept)."""
    return queries.select("query_id", tokenize(F.col("query_text")).alias("terms"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, pos, term."""
    return with_terms(queries).select("query_id", F.posexplode("terms").alias("pos", "term"))


def distinct_terms(queries: DataFrame) -> DataFrame:
    return with_terms(queries).select("query_id", F.explode(F.array_distinct("terms")).alias("term"))


def validate(queries: DataFrame) -> DataFrame:
    """Adds is_valid: id and text are both there and not empty."""
    given = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return queries.withColumn("is_valid", given("query_id") & given("query_text"))


def query_postings(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """The postings of each query's distinct terms; a term without any has one row with nulls.

    The queries' distinct terms cut the postings first, so only postings that are asked for are shuffled twice.
    """
    terms = distinct_terms(queries)
    found = postings.join(terms.select("term").distinct(), "term", "left_semi")
    return terms.join(found, "term", "left").select("query_id", "term", "doc_id", "frequency")


def document_frequency(postings: DataFrame) -> DataFrame:
    """term, df: postings, not distinct documents."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def term_idf(queries: DataFrame, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """term, idf of all query terms; one without postings has the log of the document count."""
    terms = distinct_terms(queries).select("term").distinct()
    df = postings.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    known = terms.join(df, "term", "left").crossJoin(F.broadcast(stats.select("doc_count")))  # stats has one row
    return known.select("term", idf(F.col("doc_count"), F.coalesce("df", F.lit(0))).alias("idf"))


def term_frequencies(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, doc_id, term, tf: frequencies of repeated postings are added."""
    found = query_postings(queries, postings).where("doc_id is not null")
    return found.groupBy("query_id", "doc_id", "term").agg(F.sum("frequency").alias("tf"))


def candidates(queries: DataFrame, corpus: Corpus) -> DataFrame:
    """query_id, doc_id, terms, tf (map of term to frequency), idf (map of term to idf): what the features need.

    The postings of the queries' terms are cut out of the index once and written, as frequencies and IDF both need them.
    """
    asked = distinct_terms(queries).select("term").distinct()
    postings = written(corpus.postings.select("term", "doc_id", "frequency").join(asked, "term", "left_semi"), "postings")
    tf = term_frequencies(queries, postings).groupBy("query_id", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tf"))
    weights = distinct_terms(queries).join(term_idf(queries, postings, corpus.stats), "term")
    weights = weights.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf"))
    return tf.join(with_terms(queries).join(weights, "query_id"), "query_id")


def _frequencies() -> Column:
    """The frequency of every term of the query, 0 where the document lacks it."""
    return F.transform("terms", lambda t: F.coalesce(F.try_element_at("tf", t), F.lit(0)).cast("double"))


def coverage() -> dict[str, Column]:
    covered = F.size(F.filter("terms", lambda t: F.map_contains_key("tf", t)))
    ratio = F.when(F.size("terms") > 0, covered.cast("double") / F.nullif(F.size("terms"), F.lit(0))).otherwise(F.lit(float("nan")))
    return {"CoveredQueryTermNumber": covered, "CoveredQueryTermRatio": ratio}


def tf_stats() -> dict[str, Column]:
    return {f"{k.capitalize()}TermFrequency": v for k, v in five_numbers(_frequencies()).items()}


def normalized_stats(length: Column) -> dict[str, Column]:
    """Zeros for documents without length."""
    values = F.when(length > 0, F.transform(_frequencies(), lambda x: x / F.nullif(length, F.lit(0)))).otherwise(F.array().cast("array<double>"))
    return {f"{k.capitalize()}StreamLengthNormalizedTF": v for k, v in five_numbers(values).items()}


def tfidf_stats() -> dict[str, Column]:
    """Only over terms that have an IDF."""
    weighted = F.filter("terms", lambda t: F.try_element_at("idf", t).isNotNull())
    values = F.transform(weighted, lambda t: F.coalesce(F.try_element_at("tf", t), F.lit(0)).cast("double") * F.try_element_at("idf", t))
    return {f"{k.capitalize()}TFIDF": v for k, v in five_numbers(values).items()}


def bm25(length: Column, average: Column) -> Column:
    """Summed over the query's terms in order, repeats too; terms without frequency or IDF are passed over."""
    usable = F.filter("terms", lambda t: F.map_contains_key("tf", t) & F.try_element_at("idf", t).isNotNull())
    return F.aggregate(F.transform(usable, lambda t: bm25_term(F.try_element_at("tf", t), F.try_element_at("idf", t), length, average)), F.lit(0.0), lambda a, x: a + x)


def with_lengths(found: DataFrame, corpus: Corpus) -> DataFrame:
    """Adds doc_length, url, has_metadata and avg_doc_length."""
    known = corpus.metadata.select("doc_id", "doc_length", "url", F.lit(True).alias("has_metadata"))
    joined = found.join(known, "doc_id", "left").crossJoin(F.broadcast(corpus.stats.select("avg_doc_length")))  # stats has one row
    return joined.withColumns({"doc_length": F.coalesce("doc_length", F.lit(0)), "url": F.coalesce("url", F.lit("")), "has_metadata": F.coalesce("has_metadata", F.lit(False))})


def scored(queries: DataFrame, corpus: Corpus) -> DataFrame:
    """The candidates with lengths and bm25, which is 0 where metadata are missing."""
    found = with_lengths(candidates(queries, corpus), corpus)
    return found.withColumn("bm25", F.when(F.col("has_metadata"), bm25(F.col("doc_length"), F.col("avg_doc_length"))).otherwise(0.0))


def best_first() -> list[Column]:
    """Largest BM25 first, what isn't a number last, ties by document."""
    return [F.isnan("bm25"), F.desc("bm25"), F.col("doc_id")]


def top(ranked: DataFrame, k: int = TOP) -> DataFrame:
    """The first k of each query with rank. Spark keeps k rows for each query and task up to
    spark.sql.optimizer.windowGroupLimitThreshold (1000 by default); raise that with k."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first()))).where(F.col("rank") <= k)


def features(found: DataFrame, links: DataFrame) -> DataFrame:
    """All features of scored rows. Documents without metadata have zeros, those without link statistics three zeros. Of
    several statistics of one url the largest page rank's count. Documents without a url are spread over keys of their own,
    as there may be many."""
    known = links.where("url <> ''").groupBy(F.col("url").alias("_key")).agg(F.max(F.struct("page_rank", "in_link_count", "out_link_count")).alias("_l")).select("_key", "_l.*")
    key = F.when(F.col("url") == "", F.concat(F.lit("\0"), F.col("doc_id").cast("string"))).otherwise(F.col("url"))
    joined = found.withColumn("_key", key).join(known, "_key", "left")
    values = coverage() | tf_stats() | {"StreamLength": F.col("doc_length")} | normalized_stats(F.col("doc_length")) | tfidf_stats()
    values |= {"BM25": F.col("bm25"), "NumSlashesInURL": url_slashes(F.col("url")), "LengthOfURL": url_length(F.col("url"))}
    values |= {"InlinkCount": F.coalesce("in_link_count", F.lit(0)), "OutlinkCount": F.coalesce("out_link_count", F.lit(0)), "PageRank": F.coalesce("page_rank", F.lit(0.0))}
    kept = [c for c in ("query_id", "doc_id", "rank") if c in found.columns]
    return joined.select(*kept, *[F.when(F.col("has_metadata"), values[name]).otherwise(F.lit(0)).cast(KIND[name]).alias(name) for name in FEATURES])


def rank_documents(queries: DataFrame, corpus: Corpus, k: int = TOP, with_features: bool = False) -> DataFrame:
    """query_id, doc_id, bm25, rank of the best k documents of each query, with all features if asked for: the links are
    joined after the cut, as the order doesn't depend on them."""
    best = top(scored(queries, corpus), k)
    return features(best, corpus.links) if with_features else best.select("query_id", "doc_id", "bm25", "rank")
