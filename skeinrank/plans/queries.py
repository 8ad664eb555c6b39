"""One query for each operator, over the driver's tables; doubles are rounded to six decimals where SQL is held against them."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.maths import sigmoid as sigmoid_of
from ..functions.maths import smoothed_cross_entropy
from ..functions.text import url_length, url_slashes
from ..operators import evaluation, linear, numbering, pairwise, ranking, residual, scaling
from ..schemas import FEATURES, KIND
from ..sources import corpus, files, letor

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Weights of the models that have no fit of their own (fixed values).
WEIGHTS, BIAS, PENALTY = [0.5, -0.25, 1.0, 0.75], 0.1, 1.5
LOSSES = [0.9, 0.8, 0.85, 0.7, 0.71, 0.72, 0.73, 0.74, 0.75, 0.6]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(x: Column) -> Column:
    return F.round(x, 6) + 0.0


def _inputs(spark: SparkSession, sf_dir: str, how: str = "left"):
    return corpus.queries_from_tables(spark, sf_dir), corpus.corpus_from_tables(spark, sf_dir, how)


def tokenize(spark, sf_dir):
    return ranking.query_terms(corpus.queries_from_tables(spark, sf_dir))


def query_terms_distinct(spark, sf_dir):
    return ranking.distinct_terms(corpus.queries_from_tables(spark, sf_dir))


def validate_queries(spark, sf_dir):
    q = corpus.queries_from_tables(spark, sf_dir).select(F.col("query_id").cast("string").alias("query_id"), "query_text")
    odd = spark.range(1).select(F.explode(F.array(F.struct(F.lit("").alias("query_id"), F.lit("the").alias("query_text")), F.struct(F.lit("x").alias("query_id"), F.lit("").alias("query_text")))).alias("r")).select("r.*")
    return ranking.validate(q.unionByName(odd)).select("query_id", "is_valid")


def scan_postings_term(spark, sf_dir):
    return corpus.postings_of(_table(spark, sf_dir, "documents")).where("term = 'the'").select("doc_id", "frequency")


def query_postings(spark, sf_dir):
    q, c = _inputs(spark, sf_dir)
    return ranking.query_postings(q, c.postings)


def json_decode_postings(spark, sf_dir):
    texts = ['{"term":"a","index":[{"docID":"d1","frequency":3,"positions":[1,4,7]},{"docID":"d2","frequency":2}]}', '{"term":"b","index":[]}', '{"term":"c","index":[{"docID":"d3"}]} trailing']
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, texts))).alias("json"))
    return corpus.postings_from_json(rows).select("term", "doc_id", "frequency")


def scan_metadata(spark, sf_dir):
    return _inputs(spark, sf_dir)[1].metadata


def scan_links(spark, sf_dir):
    return corpus.links_of(_table(spark, sf_dir, "pages")).withColumn("page_rank", _r(F.col("page_rank")))


def corpus_stats(spark, sf_dir):
    return corpus.stats_of(_table(spark, sf_dir, "documents")).withColumn("avg_doc_length", _r(F.col("avg_doc_length")))


def doc_freq(spark, sf_dir):
    return ranking.document_frequency(corpus.postings_of(_table(spark, sf_dir, "documents")))


def idf(spark, sf_dir):
    q, c = _inputs(spark, sf_dir)
    return ranking.term_idf(q, c.postings, c.stats).withColumn("idf", _r(F.col("idf")))


def doc_term_freq(spark, sf_dir):
    q, c = _inputs(spark, sf_dir)
    return ranking.term_frequencies(q, c.postings)


def _stats(spark, sf_dir, values: dict, suffix: str) -> DataFrame:
    found = _scored(spark, sf_dir)
    return found.select("query_id", "doc_id", *[_r(values[f"{k.capitalize()}{suffix}"]).alias(k) for k in ("sum", "min", "max", "mean", "variance")])


def _scored(spark, sf_dir, how: str = "left"):
    q, c = _inputs(spark, sf_dir, how)
    return ranking.scored(q, c)


def term_coverage(spark, sf_dir):
    c = ranking.coverage()
    return _scored(spark, sf_dir).select("query_id", "doc_id", c["CoveredQueryTermNumber"].alias("covered"), _r(c["CoveredQueryTermRatio"]).alias("ratio"))


def tf_stats(spark, sf_dir):
    return _stats(spark, sf_dir, ranking.tf_stats(), "TermFrequency")


def norm_tf_stats(spark, sf_dir):
    return _stats(spark, sf_dir, ranking.normalized_stats(F.col("doc_length")), "StreamLengthNormalizedTF")


def tfidf_stats(spark, sf_dir):
    return _stats(spark, sf_dir, ranking.tfidf_stats(), "TFIDF")


def bm25(spark, sf_dir):
    return _scored(spark, sf_dir).select("query_id", "doc_id", _r(F.col("bm25")).alias("bm25"))


def url_features(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", url_slashes(F.col("url")).alias("num_slashes"), url_length(F.col("url")).alias("url_length"))


def _features(spark, sf_dir, how: str = "left", links: str = "true") -> DataFrame:
    q, c = _inputs(spark, sf_dir, how)
    out = ranking.features(ranking.scored(q, c), c.links.where(links))
    return out.select("query_id", "doc_id", *[_r(F.col(n)).alias(n) if KIND[n] == "double" else F.col(n) for n in FEATURES])


def features_all(spark, sf_dir):
    return _features(spark, sf_dir)


def features_missing_metadata(spark, sf_dir):
    return _features(spark, sf_dir, "inner")


def features_missing_links(spark, sf_dir):
    return _features(spark, sf_dir, links="false")


def rank_documents(spark, sf_dir):
    """Ranks are by BM25 rounded to nine decimals, so that sums in another order rank alike."""
    q, c = _inputs(spark, sf_dir)
    found = ranking.scored(q, c).withColumn("bm25", F.round("bm25", 9))
    return ranking.top(found).select("query_id", "doc_id", _r(F.col("bm25")).alias("bm25"), "rank")


def top_k(spark, sf_dir):
    q, c = _inputs(spark, sf_dir)
    return ranking.top(ranking.scored(q, c).withColumn("bm25", F.round("bm25", 9)), 10).select("query_id", "doc_id", "rank")


def rank_no_match(spark, sf_dir):
    c = corpus.corpus_from_tables(spark, sf_dir)
    q = spark.range(1).select(F.lit("none").alias("query_id"), F.lit("zzzz-no-such-term qqqq-nor-this").alias("query_text"))
    return ranking.rank_documents(q, c).agg(F.count("*").alias("n"))


def rank_json(spark, sf_dir):
    return files.to_json_rows(ranking.rank_documents(*_inputs(spark, sf_dir)))


def ranked_dump(spark, sf_dir):
    path = files.save_ranked(ranking.rank_documents(*_inputs(spark, sf_dir), with_features=True), _scratch(spark))
    return spark.read.parquet(path).groupBy("query_id").agg(F.count("*").alias("n"))


def _scratch(spark: SparkSession) -> str:
    return files.scratch_path(spark, "query")


# --------------------------------------------------------------------------- judged rows and pairs


def _lines(spark, sf_dir) -> DataFrame:
    """rid and a judgement line for each row of lineitem; id 1 is none of ours."""
    rid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    pair = lambda n, c: F.concat(F.lit(f"{n}:"), (F.col(c) + 0.0).cast("string"))
    line = F.concat_ws(" ", ((F.col("l_linenumber") - 1) % 5).cast("string"), F.concat(F.lit("qid:"), F.col("l_orderkey")), pair(25, "l_quantity"), pair(110, "l_extendedprice"), pair(1, "l_tax"), pair(130, "l_discount"))
    return _table(spark, sf_dir, "lineitem").select(rid.alias("rid"), line.alias("line"))


def _judged(spark, sf_dir) -> DataFrame:
    return letor.parse(_lines(spark, sf_dir))


def letor_scan(spark, sf_dir):
    path = _scratch(spark)
    _lines(spark, sf_dir).select("line").write.text(path)
    return letor.scan(spark, path)


def letor_parse(spark, sf_dir):
    return _judged(spark, sf_dir).select("rid", "relevance", "qid", "SumTermFrequency", _r(F.col("BM25")).alias("BM25"), _r(F.col("PageRank")).alias("PageRank"), "CoveredQueryTermNumber")


BAD = ["", "3", "x qid:1 5:1", "1 qid=3 5:1", "1 qid:3 1:2:3", "1 qid:3 a:2", "1 qid:3 5:zz", "2 qid:7 5:1.9 5:-2.9"]


def letor_bad_rows(spark, sf_dir):
    rows = spark.range(1).select(F.posexplode(F.array(*map(F.lit, BAD))).alias("line_no", "line"))
    return letor.bad_lines(rows).select("line_no", "reason")


def qid_group_sizes(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n"))


def pair_join(spark, sf_dir):
    return pairwise.pair_join(_judged(spark, sf_dir)).select(F.col("a_qid").alias("qid"), F.col("a_rid").alias("i"), F.col("b_rid").alias("j"))


def pair_features(spark, sf_dir):
    return pairwise.pairs(_judged(spark, sf_dir)).select("qid", "i", "j", "SumTermFrequency", _r(F.col("BM25")).alias("BM25"), _r(F.col("PageRank")).alias("PageRank"))


def pair_label(spark, sf_dir):
    return pairwise.pairs(_judged(spark, sf_dir)).select("qid", "i", "j", F.col("Y").alias("y"))


SAMPLE = 1000


def reservoir_sample(spark, sf_dir):
    return pairwise.sample(pairwise.pairs(_judged(spark, sf_dir)), SAMPLE).select("qid", "i", "j")


def shuffle_pairs(spark, sf_dir):
    return pairwise.shuffled(pairwise.sample(pairwise.pairs(_judged(spark, sf_dir)), SAMPLE)).select("position", "qid", "i", "j")


def pairwise_examples(spark, sf_dir):
    return pairwise.create_examples(_judged(spark, sf_dir), SAMPLE).select("position", "qid", "i", "j", "SumTermFrequency", _r(F.col("BM25")).alias("BM25"), _r(F.col("PageRank")).alias("PageRank"), F.col("Y").alias("y"))


def csv_format(spark, sf_dir):
    return files.csv_fields(pairwise.pairs(_judged(spark, sf_dir))).select("i", "j", "SumTermFrequency", "BM25", "PageRank", F.col("Y").alias("y"))


def pairs_roundtrip(spark, sf_dir):
    path = _scratch(spark)
    files.save_pairs(pairwise.pairs(_judged(spark, sf_dir)).select(*FEATURES, "Y"), path)
    return files.load_pairs(spark, path).groupBy("Y").agg(F.count("*").alias("n"), F.sum("SumTermFrequency").alias("total"))


def csv_roundtrip(spark, sf_dir):
    path = _scratch(spark)
    files.save_csv(pairwise.pairs(_judged(spark, sf_dir)), path)
    return files.load_csv(spark, path).groupBy("Y").agg(F.count("*").alias("n"), F.sum("SumTermFrequency").alias("total"))


# --------------------------------------------------------------------------- models


def _numbers(spark, sf_dir) -> DataFrame:
    rid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return _table(spark, sf_dir, "lineitem").select(rid.alias("rid"), *[(F.col(c) + 0.0).alias(c) for c in NUMERIC], F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("Y"))


def _scaled(spark, sf_dir) -> DataFrame:
    df = _numbers(spark, sf_dir)
    fitted = linear.mean_std(df, NUMERIC).groupBy().pivot("feature", NUMERIC).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    both = df.crossJoin(F.broadcast(fitted))  # one row
    return both.select("rid", "Y", *[((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(c) for c in NUMERIC])


def feature_vector(spark, sf_dir):
    found = _judged(spark, sf_dir)
    return found.select("rid", F.array_join(F.transform(F.array(*[F.col(c).cast("double") for c in FEATURES]), lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("vector"))


def label_encode(spark, sf_dir):
    return _numbers(spark, sf_dir).select("rid", linear.encode_label(F.col("Y")).alias("encoded"), linear.halved_label(F.col("Y")).alias("halved"))


def feature_mean_std(spark, sf_dir):
    return linear.mean_std(_numbers(spark, sf_dir), NUMERIC).select("feature", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"))


def standardize(spark, sf_dir):
    return _scaled(spark, sf_dir).select("rid", *[_r(F.col(c)).alias(c) for c in NUMERIC])


def sigmoid(spark, sf_dir):
    return spark.range(-20, 21).select("id", _r(sigmoid_of(F.col("id").cast("double") / 2)).alias("p"))


def _p() -> Column:
    return sigmoid_of(linear.score([F.col(c) for c in NUMERIC], WEIGHTS, BIAS))


def lr_predict(spark, sf_dir):
    return _scaled(spark, sf_dir).select("rid", _r(_p()).alias("p"), F.when(_p() >= 0.5, 1).otherwise(-1).alias("class"))


def logloss(spark, sf_dir):
    penalty = 0.5 * PENALTY * sum(w * w for w in WEIGHTS)
    return _scaled(spark, sf_dir).agg(_r(F.avg(linear.log_loss(linear.encode_label(F.col("Y")), _p())) + penalty).alias("loss"))


def lr_gradient_step(spark, sf_dir):
    g = linear.gradients([F.col(c) for c in NUMERIC], linear.encode_label(F.col("Y")), WEIGHTS, BIAS, PENALTY)[:-1]
    one = _scaled(spark, sf_dir).agg(*[x.alias(f"g{i}") for i, x in enumerate(g)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("param"), _r(F.col(f"g{i}")).alias("gradient")) for i, n in enumerate([*NUMERIC, "bias"])])).alias("r")).select("r.*")


def kfold_assign(spark, sf_dir):
    return linear.with_folds(_numbers(spark, sf_dir).select("rid"), "rid", 5).select("rid", "fold")


def train_val_split(spark, sf_dir):
    return linear.split_exact(_numbers(spark, sf_dir).select("rid"), "rid").select("rid", "split")


def batches(spark, sf_dir):
    """Mini-batches in a seeded order: rows of a batch of 16384, the last may be short."""
    placed = numbering.numbered(_numbers(spark, sf_dir).select(F.md5(F.concat_ws(":", F.lit("batch1"), "rid")).alias("h")), "h")
    return placed.groupBy(F.floor(F.col("position") / 16384).alias("batch")).agg(F.count("*").alias("n"))


def _labels(spark, sf_dir) -> DataFrame:
    sign = lambda c: F.when(F.col(c) == 1, 1).otherwise(-1).alias(c)
    return _table(spark, sf_dir, "labels").select(sign("quality"), sign("toxic"))


def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_labels(spark, sf_dir), F.col("quality"), F.col("toxic"))


def confusion_table(spark, sf_dir):
    return evaluation.confusion_table(_table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"), [0, 1])


def accuracy(spark, sf_dir):
    return evaluation.accuracy(confusion_matrix(spark, sf_dir)).select(_r(F.col("accuracy")).alias("accuracy"))


def classification_report(spark, sf_dir):
    found = evaluation.report(_table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"), [0, 1])
    return found.select("class", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def early_stop_trace(spark, sf_dir):
    """Both stop rules on a list of losses: 5 in a row not below the one before, and 3 without a new best."""
    rows = spark.range(1).select(F.posexplode(F.array(*map(F.lit, LOSSES))).alias("epoch", "loss"))
    w = Window.orderBy("epoch")  # a literal list
    best = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("improved", F.coalesce(F.col("loss") < F.lag("loss").over(w), F.lit(True))).withColumn("is_best", F.coalesce(F.col("loss") < best, F.lit(True)))
    since = lambda c: F.col("epoch") - F.max(F.when(F.col(c), F.col("epoch"))).over(w)
    return marked.select("epoch", "loss", F.min("loss").over(w).alias("best"), (since("improved") >= 5).alias("stop_previous"), (since("is_best") >= 3).alias("stop_best"))


#: The grid, folds and epochs of the reference's train command.
PENALTIES, FOLDS, FOLD_EPOCHS, EPOCHS = (1.0, 1.25, 1.5, 1.75, 2.0, 2.25), 5, 100, 1000


def _ordered_pairs(spark, sf_dir) -> DataFrame:
    return pairwise.pairs(_judged(spark, sf_dir)).withColumn("_o", F.md5(F.concat_ws(":", F.lit("shuffle42"), "qid", "i", "j")))


def lr_train_eval(spark, sf_dir):
    """The penalty by grid search, the fit and the test over all pairs and features."""
    found = _ordered_pairs(spark, sf_dir).withColumn("_f", F.pmod(F.xxhash64("i", "j"), F.lit(5)))
    rows = files.written(found.select(*FEATURES, "Y", "_o", "_f"), "pairs")
    train = rows.where("_f <> 0")
    best, _ = linear.grid_search(train, list(FEATURES), "_o", list(PENALTIES), FOLDS, epochs=FOLD_EPOCHS)
    model = linear.fit_together(train, list(FEATURES), [(best, None)], epochs=EPOCHS)[0]
    return evaluation.confusion(rows.where("_f = 0"), F.col("Y"), model.predicted())


def cv_argmax(spark, sf_dir):
    rows = files.written(_ordered_pairs(spark, sf_dir).select(*FEATURES, "Y", "_o"), "pairs")
    best, means = linear.grid_search(rows, list(FEATURES), "_o", list(PENALTIES), FOLDS, epochs=FOLD_EPOCHS)
    return spark.createDataFrame([(p, a, p == best) for p, a in means], "penalty double, accuracy double, best boolean")


def robust_scale_fit(spark, sf_dir):
    return scaling.robust_fit(_numbers(spark, sf_dir), NUMERIC).select("feature", _r(F.col("median")).alias("median"), _r(F.col("iqr")).alias("iqr"))


def robust_scale(spark, sf_dir):
    df = _numbers(spark, sf_dir)
    fitted = {r.feature: (r.median, r.iqr) for r in scaling.robust_fit(df, NUMERIC).collect()}  # a row for each feature
    return df.select("rid", *scaling.robust_scaled(NUMERIC, fitted)).select("rid", *[_r(F.col(c)).alias(c) for c in NUMERIC])


def anova_f(spark, sf_dir):
    return scaling.anova_f(_numbers(spark, sf_dir), NUMERIC, "Y").select("feature", _r(F.col("f")).alias("f"))


def ce_smoothed(spark, sf_dir):
    return _scaled(spark, sf_dir).agg(_r(F.avg(smoothed_cross_entropy(linear.halved_label(F.col("Y")), _p()))).alias("loss"))


#: Epochs of the registered query; fit() itself has 50.
NETWORK_EPOCHS = 12


def feature_selection(spark, sf_dir):
    """All columns by their F with whether they are among the best 50 (of four, as of 24, none goes)."""
    scores = scaling.anova_f(_numbers(spark, sf_dir), NUMERIC, "Y")
    return scores.select("feature", F.col("feature").isin(scaling.select_best(scores)).alias("selected"))


def neural_eval(spark, sf_dir):
    """The residual network: three fifths of the rows to train on, one to validate, one to test."""
    df = _numbers(spark, sf_dir).withColumn("y", linear.halved_label(F.col("Y"))).withColumn("_f", F.pmod(F.xxhash64("rid"), F.lit(5)))
    # Dealt evenly over the cores and written once, as the quantiles go through the rows a dozen times.
    cores = max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    df = files.written(df.repartition(cores, "rid").sortWithinPartitions("rid").select(*NUMERIC, "y", "_f"), "numbers")
    train = df.where("_f > 1")
    fitted = {r.feature: (r.median, r.iqr) for r in scaling.robust_fit(train, NUMERIC).collect()}  # a row for each feature
    scaled = df.select("_f", "y", *scaling.robust_scaled(NUMERIC, fitted))
    model = residual.fit(scaled.where("_f > 1"), scaled.where("_f = 1"), NUMERIC, "y", epochs=NETWORK_EPOCHS)
    return evaluation.confusion_table(model.predicted(scaled.where("_f = 0")), F.col("y"), F.col("prediction"), [0, 1])


def evaluation_json(spark, sf_dir):
    """What the front-end reports of a request: the time that ranking takes, and how much was ranked."""
    began = time.perf_counter_ns()
    ranked = ranking.rank_documents(*_inputs(spark, sf_dir)).count()
    took = time.perf_counter_ns() - began
    n = _table(spark, sf_dir, "documents").count()
    record = {"total_storage": files.stored_bytes(spark, sf_dir), "algorithm_update_time": took, "query_data": {"num_documents_parsed": n, "num_ranked_documents": ranked, "process_time": took, "cache_exists": False}}
    return files.metrics_frame(spark, record).select(F.to_json(F.struct("*")).alias("json"))


ALL = (
    tokenize, query_terms_distinct, validate_queries, scan_postings_term, query_postings, json_decode_postings, scan_metadata, scan_links, corpus_stats, doc_freq, idf, doc_term_freq,
    term_coverage, tf_stats, norm_tf_stats, tfidf_stats, bm25, url_features, features_all, features_missing_metadata, features_missing_links, rank_documents, top_k, rank_no_match, rank_json, ranked_dump,
    letor_scan, letor_parse, letor_bad_rows, qid_group_sizes, pair_join, pair_features, pair_label, pairwise_examples, reservoir_sample, shuffle_pairs, csv_format, pairs_roundtrip, csv_roundtrip,
    feature_vector, label_encode, feature_mean_std, standardize, sigmoid, lr_predict, logloss, lr_gradient_step, kfold_assign, train_val_split, batches, confusion_matrix, confusion_table, accuracy, classification_report,
    early_stop_trace, lr_train_eval, cv_argmax, robust_scale_fit, robust_scale, anova_f, feature_selection, ce_smoothed, neural_eval, evaluation_json,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}
