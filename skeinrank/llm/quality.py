"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The target model is counted from labelled good documents, the raw model from all documents. A document's log weight is
the sum of log(target / raw) over its n-grams; Gumbel noise from a hash of its id is added, and the k documents with the
largest sums are kept, which samples k documents without replacement in proportion to their weights. k is the number of
documents whose log weight reaches the cut that separates the labelled sample best, unless it is given.

Cases: a null or empty text has no n-grams and log weight 0; texts are read whole; rows with a null id take part with the
noise of id null; repeated rows have equal sums and equal fates, so ties at the threshold are all kept; without any
labelled good document all log weights are 0 and all documents are kept; an empty table gives an empty result; in tables
of scores, columns named as the results are replaced, and the sampled documents have all their columns as they were.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, fresh, materialize, mix, slices, text_buffers, word_hashes, word_spans
from ._labelled import FIT_ROWS, kth_largest, with_labels

BUCKETS = 1 << 14

_UPPER, _DIGIT, _OTHER = (np.zeros(256, np.int64) for _ in range(3))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_OTHER[[c for c in range(128) if not chr(c).isalnum()]] = 1


def ngrams(buf: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and the row of each: words, pairs of words, and runs of one to three word shapes.

    A shape has the word's length, whether it is upper case, holds digits or ends in a sign, and whether it is the word
    before or the one before that; so text that repeats or shouts has n-grams of its own whatever its words are.
    """
    s, e, first = word_spans(buf, offs)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    words = word_hashes(LOWER[buf], s, e)
    inside = np.cumsum(np.concatenate([[0], (_UPPER[buf] + (_DIGIT[buf] << 20) + (_OTHER[buf] << 40))]))
    found = inside[e] - inside[s]
    upper, digits, other, length = found & 0xFFFFF, (found >> 20) & 0xFFFFF, found >> 40, e - s
    ago = lambda n: np.append(np.zeros(min(n, len(words)), bool), (words[n:] == words[:-n]) & (row[n:] == row[:-n])) if n < len(words) else np.zeros(len(words), bool)
    shape = np.minimum(length, 15) | (np.minimum(upper, 2) << 4) | ((upper == length) << 6) | ((digits > 0) << 7) | (np.minimum(other, 3) << 8) | (_OTHER[buf[e - 1]] << 10) | (ago(1) << 11) | (ago(2) << 12)
    shape = mix(shape.astype(np.uint64) + np.uint64(0xABCD1234))
    out, rows = [words], [row]
    for values, n in ((words, 2), (shape, 1), (shape, 2), (shape, 3)):
        if len(values) < n:
            continue
        run = values.copy() if n == 1 else values[: len(values) - n + 1] * np.uint64(2 * n + 1)
        for j in range(1, n):
            run = mix(run + values[j : len(values) - n + 1 + j])
        whole = row[: len(run)] == row[n - 1 :]
        out.append((run + np.uint64(n))[whole])
        rows.append(row[: len(run)][whole])
    return (mix(np.concatenate(out)) % np.uint64(buckets)).astype(np.int64), np.concatenate(rows)


def _parts(batch: pa.RecordBatch, at: int, limit: int = 1 << 20):
    """Row range, buckets and rows of the n-grams of a batch's texts, some MB at a time."""
    raw, offs = text_buffers(batch.column(at))
    for lo, hi in slices(offs, limit):
        yield lo, hi, *ngrams(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def count_models(docs: DataFrame, text_col: str = "text", label: str = "_label") -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of the documents labelled 1 and of all documents. Each task gives one row for each bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1
            for lo, hi, bucket, row in _parts(batch, 0):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[lo:hi][row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(target[at]), pa.array(raw[at])], names=["bucket", "target", "raw"])

    counts = docs.select(F.col(text_col), F.col(label).cast("int")).mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw"))
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, t, r in counts.collect():  # a row for each bucket at most
        target[b], raw[b] = t, r
    return target, raw


@dataclass
class QualityModel:
    log_ratio: np.ndarray
    cut: float


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = FIT_ROWS) -> QualityModel:
    """labels: doc_id and quality (1: good). At most bound labelled documents serve, all documents make the raw model."""
    marked = with_labels(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, F.col("quality").cast("int"), "doc_id", bound)
    target, raw = count_models(marked)
    if not target.sum():
        return QualityModel(np.zeros(BUCKETS), float("-inf"))
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    seen = log_weights(marked.where("_label is not null"), QualityModel(ratio, 0.0), "text", ["_label"]).select("_label", "log_weight").collect()
    return QualityModel(ratio, best_cut(np.array([r.log_weight for r in seen]), np.array([r._label for r in seen]) == 1))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut with the largest sum of the shares of good at or above it and of others below it; -inf without others."""
    if good.all():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    gain = np.concatenate([[0.0], np.cumsum(~g) / (~g).sum() - np.cumsum(g) / g.sum()])
    gain[1:-1][w[1:] == w[:-1]] = -1  # not between equal weights
    at = int(gain.argmax())
    return float(w[0] - 1 if at == 0 else w[-1] + 1 if at == len(w) else (w[at - 1] + w[at]) / 2)


def log_weights(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None, name: str = "log_weight") -> DataFrame:
    """The columns keep (all without it) and the log weight under its name."""
    keep = [c for c in (keep or docs.columns) if c != name]
    ratio = model.log_ratio
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = np.zeros(batch.num_rows)
            for lo, hi, bucket, row in _parts(batch, n):
                weights[lo:hi] = np.bincount(row, ratio[bucket], hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(weights)], names=[*keep, name])

    kinds = docs.select(*keep).schema.add(name, "double")
    return docs.select(*keep, F.col(text_col).alias(fresh("text", docs))).mapInArrow(run, kinds)


def gumbel(id_col: str, seed: int = 17) -> Column:
    """Standard Gumbel noise from the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = 17) -> tuple[DataFrame, float, QualityModel]:
    """Scores (id, log_weight, sampling_key, kept) of all documents, the threshold of sampling_key, and the model."""
    model = fit(docs, labels, id_col, text_col)
    scores = log_weights(docs, model, text_col, [id_col]).withColumn("sampling_key", F.col("log_weight") + gumbel(id_col, seed))
    scores, _ = materialize(scores, "quality-scores")
    if k is None:
        k = scores.where(F.col("log_weight") >= F.lit(model.cut)).count()
    threshold = kth_largest(scores, "sampling_key", k)
    return scores.withColumn("kept", F.col("sampling_key") >= F.lit(threshold)), threshold, model


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, seed: int = 17) -> DataFrame:
    """The sampled documents, with their columns. They are scored again rather than joined with their scores, so no text is shuffled."""
    _, threshold, model = resample(docs, labels, id_col, text_col, k, seed)
    weight = fresh("log_weight", docs)
    scored = log_weights(docs, model, text_col, name=weight)
    return scored.where(F.col(weight) + gumbel(id_col, seed) >= F.lit(threshold)).select(*docs.columns)


def op10_quality_resampling(spark, sf_dir: str) -> DataFrame:
    scores, _, _ = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.select("doc_id", "log_weight", "sampling_key", "kept")
