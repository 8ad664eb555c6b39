"""The pipeline's stages on the smallest tables: their columns, and that their decisions take effect."""

from pathlib import Path

import pytest

import corpus_pipeline
from skeinrank.llm import minhash_dedup, secrets

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DIR).exists(), reason="no tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        kept[name] = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "MinHash near-dedup":
            assert minhash_dedup.near_duplicates(out, 80).where("component_id <> doc_id").count() == 0
        if name == "secret scans":
            assert all(not secrets.base_spans(r.text) for r in out.collect())
        if name == "mixing to target weights":
            labels = spark.read.parquet(f"{DIR}/labels.parquet")
            clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").join(docs, "doc_id").select("doc_id").collect()}
            assert len(clean - set(kept[name])) <= 0.02 * len(clean)
        docs = out
    names = [n for n, _ in corpus_pipeline.STAGES]
    for a, b in zip(names, names[1:], strict=False):
        assert set(kept[b]) <= set(kept[a])


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, columns named as an operator's own, and no rows."""
    pytest.importorskip("public_tokenizers")
    prose = " ".join(f"word{i}" for i in range(200))
    rows = [(0, prose, "en", "a", len(prose), "x"), (0, prose, "en", "a", len(prose), "x"), (1, None, None, None, None, None), (2, "", "en", "b", 0, "y"), (None, prose, "de", "b", 3, "z"), (None, None, None, None, None, None), (3, "q " * 40_000, "en", "a", 80_000, "x"), (4, "password=abcdEFGH12345678", "en", "a", 25, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, posteriors string")
    for k, labelled in enumerate(([(0, 1, 0), (3, 0, 1), (4, 1, None), (None, 1, 1)], [])):
        folder = str(tmp_path / str(k))
        spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.schema == docs.schema, name
            found = out.collect()
            assert found and stage(spark, docs.where("false"), folder).count() == 0, name
            if name == "secret scans":
                assert [(r.text, r.n_chars, r.posteriors) for r in found if r.doc_id == 4] == [("[SECRET]", 8, "w")]
            if name == "packing":
                assert len({(r.doc_id, r.start) for r in found}) < len(found) and sum(r.doc_id is None for r in found) == 2
