"""Column names and types that everything else agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

#: The ranking features in their fixed order, with type and the id they have in LETOR files (fixed values).
FEATURE_TABLE = (
    ("CoveredQueryTermNumber", "int", 5),
    ("CoveredQueryTermRatio", "double", 10),
    ("SumTermFrequency", "int", 25),
    ("MinTermFrequency", "int", 30),
    ("MaxTermFrequency", "int", 35),
    ("MeanTermFrequency", "double", 40),
    ("VarianceTermFrequency", "double", 45),
    ("StreamLength", "int", 15),
    ("SumStreamLengthNormalizedTF", "double", 50),
    ("MinStreamLengthNormalizedTF", "double", 55),
    ("MaxStreamLengthNormalizedTF", "double", 60),
    ("MeanStreamLengthNormalizedTF", "double", 65),
    ("VarianceStreamLengthNormalizedTF", "double", 70),
    ("SumTFIDF", "double", 75),
    ("MinTFIDF", "double", 80),
    ("MaxTFIDF", "double", 85),
    ("MeanTFIDF", "double", 90),
    ("VarianceTFIDF", "double", 95),
    ("BM25", "double", 110),
    ("NumSlashesInURL", "int", 126),
    ("LengthOfURL", "int", 127),
    ("InlinkCount", "int", 128),
    ("OutlinkCount", "int", 129),
    ("PageRank", "double", 130),
)
FEATURES = tuple(name for name, _, _ in FEATURE_TABLE)
KIND = {name: kind for name, kind, _ in FEATURE_TABLE}
LETOR_ID = {name: number for name, _, number in FEATURE_TABLE}

#: Saturation and length normalisation of BM25, and the number of documents kept for a query (fixed values).
K1, B, TOP = 1.2, 0.75, 1000

#: Replies of the index, metadata, statistics and link services.
POSTINGS_JSON = "term string, index array<struct<docID: string, frequency: int, positions: array<int>>>"
METADATA_JSON = "docID string, metadata struct<docLength: int, timeLastUpdated: string, docType: string, imageCount: int, docTitle: string, URL: string>"
STATS_JSON = "avgDocLength double, docCount int"
LINKS_JSON = "pageRank double, inLinkCount int, outLinkCount int"
PAIR_SCHEMA = T.StructType([T.StructField(name, T.IntegerType() if KIND[name] == "int" else T.DoubleType()) for name in FEATURES] + [T.StructField("Y", T.IntegerType())])
