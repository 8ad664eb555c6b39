"""Retrieval and features, case by case, against plain arithmetic."""

import math

import pytest
from pyspark.sql import functions as F

from skeinrank.functions.maths import bm25_term, idf
from skeinrank.functions.text import token_count, tokenize, url_length, url_slashes
from skeinrank.operators import ranking
from skeinrank.schemas import FEATURES, KIND
from skeinrank.sources import corpus, files

INF = float("inf")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


TOKENS = {
    "this is simple": ["this", "is", "simple"],
    "  spaced   out   text  ": ["spaced", "out", "text"],
    "": [],
    "hello, world! how's it going?": ["hello,", "world!", "how's", "it", "going?"],
    "word": ["word"],
    "a b c\u0085d\x0be": ["a", "b", "c", "d", "e"],
    " \t\n ": [],
    "A a A": ["A", "a", "A"],
}


def test_tokenize(spark):
    rows = spark.createDataFrame([(t,) for t in [*TOKENS, None]], "t string").select("t", tokenize(F.col("t")).alias("x"), token_count(F.col("t")).alias("n")).collect()
    assert {r.t: r.x for r in rows} == TOKENS | {None: []}
    assert all(r.n == len(r.x) for r in rows)


URLS = {"https://example.com": (2, 19), "https://example.com/path/to/resource": (5, 36), "https://example.com/a?b=c": (3, 25), "/": (1, 1), "": (0, 0), None: (0, 0), "é/": (1, 3)}


def test_urls(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", url_slashes(F.col("u")), url_length(F.col("u"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == URLS


@pytest.mark.parametrize("n, df, want", [(3, 2, 0.0), (3, 1, math.log(1.5)), (10, 0, math.log(10)), (5, 9, math.log(0.5)), (1, 1, math.log(0.5)), (0, 0, -INF), (0, 4, -INF), (456789, 1000, math.log(456789 / 1001))])
def test_idf(spark, n, df, want):
    assert one(spark, idf(F.lit(n), F.lit(df)).alias("x")).x == pytest.approx(want)


@pytest.mark.parametrize("tf, weight, length, average", [(3, 1.2, 100, 120.0), (1, -0.5, 100, 120.0), (50, 1.5, 1000, 500.0), (0, 1.2, 10, 5.0), (2, 1.0, 10, 0.0), (2, 1.0, 0, 0.0), (4, 2.0, 0, 7.0)])
def test_bm25_term(spark, tf, weight, length, average):
    got = one(spark, bm25_term(F.lit(tf), F.lit(weight), F.lit(length), F.lit(average)).alias("x")).x
    relative = length / average if average else (INF if length else math.nan)
    want = weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * relative))
    assert got == pytest.approx(want, nan_ok=True)


def tables(spark, postings, metadata, stats, links=()):
    return corpus.Corpus(
        spark.createDataFrame(postings, "term string, doc_id string, frequency int"),
        spark.createDataFrame(metadata, "doc_id string, doc_length int, url string").withColumns({"time_last_updated": F.lit(""), "doc_type": F.lit(""), "image_count": F.lit(0), "doc_title": F.lit("")}),
        spark.createDataFrame([stats], "avg_doc_length double, doc_count long"),
        spark.createDataFrame(list(links), "url string, page_rank double, in_link_count int, out_link_count int"),
    )


def asked(spark, **queries):
    return spark.createDataFrame(list(queries.items()) or [], "query_id string, query_text string")


def five(values):
    if not values:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    mean = sum(values) / len(values)
    return sum(values), min(values), max(values), mean, sum((x - mean) ** 2 for x in values) / len(values)


def expected(terms, tf, weights, length, average, url="", link=(0.0, 0, 0), known=True):
    """The features by hand. tf: frequencies in the document, weights: IDF by term."""
    if not known:
        return dict.fromkeys(FEATURES, 0)
    out = {"CoveredQueryTermNumber": sum(t in tf for t in terms), "StreamLength": length, "NumSlashesInURL": url.count("/"), "LengthOfURL": len(url.encode()), "PageRank": link[0], "InlinkCount": link[1], "OutlinkCount": link[2]}
    out["CoveredQueryTermRatio"] = out["CoveredQueryTermNumber"] / len(terms) if terms else math.nan
    raw = [tf.get(t, 0) for t in terms]
    for suffix, values in (("TermFrequency", raw), ("StreamLengthNormalizedTF", [x / length for x in raw] if length > 0 else []), ("TFIDF", [tf.get(t, 0) * weights[t] for t in terms if t in weights])):
        out |= {k + suffix: v for k, v in zip(("Sum", "Min", "Max", "Mean", "Variance"), five(values), strict=True)}
    out["BM25"] = sum(weights[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * length / average)) for t in terms if t in tf and t in weights)
    return out


def test_features_and_ranks(spark):
    """Terms found or not, repeated terms and postings, equal and large frequencies, empty documents, missing metadata and
    links, a query that matches nothing and one without terms."""
    postings = [("a", "d1", 2), ("a", "d1", 1), ("a", "d2", 1), ("b", "d1", 1), ("b", "d3", 5), ("c", "d3", 5), ("big", "d4", 1_000_000), ("a", "none", 4), ("a", "empty", 2)]
    metadata = [("d1", 100, "https://example.com/a"), ("d2", 50, ""), ("d3", 1000, "é/x"), ("d4", 2_000_000, "u"), ("empty", 0, "/")]
    links = [("https://example.com/a", 0.85, 123, 45), ("u", 0.0, 0, 0), ("elsewhere", 1.0, 1, 1)]
    average, count = 120.0, 10
    found = tables(spark, postings, metadata, (average, count), links)
    queries = {"q1": "a", "q2": "a b", "q3": "b  c", "q4": "a a b", "q5": "big", "q6": "nothing", "q7": "a nothing", "q8": " "}
    got = {(r.query_id, r.doc_id): r.asDict() for r in ranking.rank_documents(asked(spark, **queries), found, with_features=True).collect()}
    lengths, urls, link = {d: n for d, n, _ in metadata}, {d: u for d, _, u in metadata}, {u: tuple(x) for u, *x in links}
    want = {}
    for q, text in queries.items():
        terms = text.split()
        weights = {t: math.log(count / (sum(p[0] == t for p in postings) + 1)) for t in terms}
        for d in {p[1] for p in postings if p[0] in terms}:
            tf = {}
            for t, doc, n in postings:
                if doc == d and t in terms:
                    tf[t] = tf.get(t, 0) + n
            want[q, d] = expected(terms, tf, weights, lengths.get(d, 0), average, urls.get(d, ""), link.get(urls.get(d, ""), (0.0, 0, 0)), d in lengths)
    assert got.keys() == want.keys()
    for key, features in want.items():
        assert [got[key][n] for n in FEATURES] == pytest.approx([int(features[n]) if KIND[n] == "int" else features[n] for n in FEATURES], abs=1e-9), key
    for q in queries:
        order = sorted((d for k, d in want if k == q), key=lambda d: (-want[q, d]["BM25"], d))
        assert [d for d, _ in sorted(((d, r["rank"]) for (k, d), r in got.items() if k == q), key=lambda x: x[1])] == order


def test_nothing_to_rank(spark):
    empty = tables(spark, [], [], (0.0, 0))
    assert ranking.rank_documents(asked(spark, q="a"), empty, with_features=True).count() == 0
    some = tables(spark, [("a", "d", 1)], [("d", 3, "")], (3.0, 1))
    assert ranking.rank_documents(spark.createDataFrame([], "query_id string, query_text string"), some).count() == 0
    postings = ranking.query_postings(asked(spark, q="a b a"), some.postings).collect()
    assert sorted((r.term, r.doc_id or "") for r in postings) == [("a", "d"), ("b", "")]  # a term without postings is there


def test_order_and_cut(spark):
    rows = [("q", f"d{i:04d}", 1.0) for i in range(1005)] + [("q", "best", 2.0), ("q", "worst", -1.0), ("q", "nan", math.nan), ("q", "zero", 0.0)]
    got = [r.doc_id for r in ranking.top(spark.createDataFrame(rows, "query_id string, doc_id string, bm25 double")).orderBy("rank").collect()]
    assert got == ["best", *[f"d{i:04d}" for i in range(999)]]
    few = [r for r in rows if r[1] in ("zero", "worst", "nan", "best")]
    got = [r.doc_id for r in ranking.top(spark.createDataFrame(few, "query_id string, doc_id string, bm25 double")).orderBy("rank").collect()]
    assert got == ["best", "zero", "worst", "nan"]


def test_links_without_url_and_repeated(spark):
    found = tables(spark, [("a", d, 1) for d in ("x", "y", "z")], [("x", 1, ""), ("y", 1, "u"), ("z", 1, "")], (1.0, 9), [("u", 0.5, 1, 2), ("u", 0.25, 7, 7), ("", 9.0, 9, 9)])
    got = {r.doc_id: (r.PageRank, r.InlinkCount, r.OutlinkCount) for r in ranking.rank_documents(asked(spark, q="a"), found, with_features=True).collect()}
    assert got == {"x": (0.0, 0, 0), "y": (0.5, 1, 2), "z": (0.0, 0, 0)}


def json_rows(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, json string")


POSTINGS = '{"term":"testterm1","index":[{"docID":"doc1","frequency":3,"positions":[1,4,7]},{"docID":"doc2","frequency":2,"positions":[2,5]}]}'
METADATA = '{"docID":"other","metadata":{"docLength":2450,"timeLastUpdated":"2024-11-09T15:30:00Z","docType":"PDF","imageCount":3,"docTitle":"Introduction","URL":"http://example.com/1"}}'


def test_replies(spark):
    got = [tuple(r) for r in corpus.postings_from_json(json_rows(spark, POSTINGS, '{"term":"none","index":[]}')).collect()]
    assert got == [("testterm1", "doc1", 3, [1, 4, 7]), ("testterm1", "doc2", 2, [2, 5])]
    got = [tuple(r) for r in corpus.metadata_from_json(json_rows(spark, METADATA, "{}", "not json", '{"metadata":{"docLength":7}}')).collect()]
    blank = (0, "", "", 0, "", "")
    assert got == [("0", 2450, "2024-11-09T15:30:00Z", "PDF", 3, "Introduction", "http://example.com/1"), ("1", *blank), ("2", *blank), ("3", 7, *blank[1:])]
    assert tuple(corpus.stats_from_json(json_rows(spark, '{"avgDocLength":798.873,"docCount":456789}')).first()) == (798.873, 456789)
    assert tuple(corpus.stats_from_json(json_rows(spark, "{}")).first()) == (0.0, 0)
    links = corpus.links_from_json(json_rows(spark, '{"pageRank":0.85,"inLinkCount":123,"outLinkCount":45}', "{}", "broken").withColumnRenamed("doc_id", "url")).collect()
    assert [tuple(r) for r in links] == [("0", 0.85, 123, 45), ("1", 0.0, 0, 0), ("2", 0.0, 0, 0)]


@pytest.mark.parametrize("decode", [corpus.postings_from_json, corpus.stats_from_json])
def test_malformed_replies_fail(spark, decode):
    with pytest.raises(Exception, match="(?i)malformed"):
        decode(json_rows(spark, '{"term": [1}')).collect()


def test_names_and_dumps(spark, tmp_path):
    for base in ("testfile", "myfile", "file_with_special_chars!@#"):
        names = {files.unique_name(base) for _ in range(50)}
        assert len(names) == 50 and all(n.startswith(base + "_") for n in names)
    found = tables(spark, [("a", "x", 1), ("a", "y", 2)], [("x", 1, ""), ("y", 4, "")], (2.0, 9))
    ranked = ranking.rank_documents(asked(spark, q="a", r="a"), found, with_features=True)
    path = files.save_ranked(ranked, str(tmp_path))
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in spark.read.parquet(path).collect()) == sorted((r.query_id, r.doc_id, r["rank"]) for r in ranked.collect())
    said = files.to_json_rows(ranking.rank_documents(asked(spark, q="a"), found)).collect()
    assert [r.query_id for r in said] == ["q"] and said[0].json.index('"rank":1') < said[0].json.index('"rank":2')


def test_files(spark, tmp_path):
    assert files.directory_entries(spark, str(tmp_path / "none")) == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_bytes(b"123")
    (tmp_path / "y").write_bytes(b"4567")
    assert files.stored_bytes(spark, str(tmp_path)) == 7 and files.directory_entries(spark, str(tmp_path)) == 3
    files.append_metrics(spark, {"total_storage": 5, "query_data": {"num_ranked_documents": 2}}, str(tmp_path / "m"))
    files.append_metrics(spark, {}, str(tmp_path / "m"))
    assert sorted(tuple(r.query_data) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [(0, 0, 0, False), (0, 2, 0, False)]


def test_shared_url(spark):
    """two pages with one URL give a document one statistic; its terms count once."""
    links = [("u", 0.25, 3, 4), ("u", 0.5, 1, 2)]
    found = tables(spark, [("a", "d", 2), ("b", "d", 1)], [("d", 10, "u")], (10.0, 3), links)
    got = ranking.rank_documents(asked(spark, q="a b"), found, with_features=True).collect()
    assert [(r.CoveredQueryTermNumber, r.CoveredQueryTermRatio, r.SumTermFrequency, r.PageRank, r.InlinkCount, r.OutlinkCount) for r in got] == [(2, 1.0, 3, 0.5, 1, 2)]
