"""Mixing to target weights with soft membership: posteriors of domains, and rates whose expected totals match targets.

A softmax regression on the hashed words a text has, fitted to a labelled table, gives each document its domain posteriors:
of all words those count that are spread over the labelled domains least evenly, so that common and rare words alike don't
blur the posteriors of clean texts. Projected gradient then fits one nonnegative rate for each document: the least squares distance between the expected
domain token totals (sum of rate * tokens * posterior) and the targets, in the metric of their Gram matrix. Every step
moves a document's rate along its posteriors only, from 1, so documents of the same kind get the same rate. An iteration
is one aggregation that brings a number for each domain to the driver.

Cases: a null or empty text has no words and the posteriors of the offsets alone, its rate moves no total; texts are
read whole; rows with a null id and repeated rows have rates like any; a domain without labelled documents has posterior
0, and its target cannot be met (the fit ends at the nearest totals); without labels nothing is known, all posteriors are
equal and all rates are 1; an empty table gives
an empty result; in tables of posteriors, columns named as the results are replaced, and mixed documents have all their
columns as they were.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ._common import LOWER, fresh, materialize, slices, text_buffers, word_hashes, word_spans
from ._labelled import FIT_ROWS, with_labels

BUCKETS = 1 << 16
#: Most words that a classifier looks at, and the least G statistic (chance below 0.001) of one.
FEATURES, LEAST_G = 512, 10.8
#: Variance of a word's weight beforehand. A small one makes the posteriors of short texts softer than their words are.
VARIANCE = 16.0
#: The domains of the labels table, and each one's target as a multiple of its present expected total.
DOMAINS = ("clean", "toxic", "junk")
TARGETS = {"clean": 1.25, "toxic": 0.25, "junk": 0.25}


def domain_of_labels() -> Column:
    return F.when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)


def _words(batch: pa.RecordBatch, at: int):
    raw, offs = text_buffers(batch.column(at))
    for lo, hi in slices(offs):
        buf, o = LOWER[raw[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
        s, e, first = word_spans(buf, o)
        yield lo, hi, (word_hashes(buf, s, e) % np.uint64(BUCKETS)).astype(np.int64), np.repeat(np.arange(hi - lo), np.diff(first)), np.diff(first)


@dataclass
class DomainModel:
    """Softmax weights of the words looked at (domains x features), each bucket's feature (-1: none), and the offset of each
    domain, which is -inf for one without labelled documents."""

    weights: np.ndarray
    slots: np.ndarray
    offsets: np.ndarray
    labelled: int


def _present(bucket: np.ndarray, row: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each distinct pair."""
    pairs = np.unique(row * values + bucket)
    return pairs // values, pairs % values


def _of_features(batch: pa.RecordBatch, at: int, slots: np.ndarray):
    """Row range, then the row and the feature of every feature a text has, and the number of words of each text."""
    for lo, hi, bucket, row, count in _words(batch, at):
        slot = slots[bucket]
        yield lo, hi, *_present(slot[slot >= 0], row[slot >= 0], FEATURES), count


def uneven(counts: np.ndarray) -> np.ndarray:
    """The buckets whose documents are spread over the domains least as those of all buckets are, FEATURES at most. counts:
    documents by domain and bucket."""
    total, by_domain = counts.sum(0), counts.sum(1)
    expected = np.outer(by_domain / max(by_domain.sum(), 1), total)
    g = 2 * (counts * np.log(np.where(counts > 0, counts, 1) / np.where(expected > 0, expected, 1))).sum(0)
    order = np.argsort(-g, kind="stable")[:FEATURES]
    return order[g[order] >= LEAST_G]


def softmax_regression(x: np.ndarray, label: np.ndarray, domains: int, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights (domains x features) and offsets for rows of 0 and 1, with weights of VARIANCE beforehand. Each round is a
    Newton step under a fixed bound of the curvature, with Nesterov's momentum."""
    n, f = x.shape
    seen = np.bincount(label, minlength=domains) > 0
    x = np.column_stack([x, np.ones(n, np.float32)])
    goal = np.eye(domains, dtype=np.float32)[label]
    keep = np.append(np.full(f, 1 / VARIANCE), 1e-3)
    solve = np.linalg.inv(0.5 * (x.T @ x).astype(float) + np.diag(keep)).astype(np.float32)
    w = ahead = np.zeros((f + 1, domains), np.float32)
    for k in range(rounds):
        z = np.where(seen, x @ ahead, -np.inf)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead + solve @ (x.T @ (goal - p) - keep[:, None].astype(np.float32) * ahead)
        w, ahead = new, new + np.float32(k / (k + 3)) * (new - w)
    return w[:f].T.astype(float), np.where(seen, w[f], -np.inf).astype(float)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, domains: int, id_col: str = "doc_id", text_col: str = "text", bound: int = FIT_ROWS) -> DomainModel:
    """From at most bound labelled documents; FEATURES bits of each come to the driver."""
    marked = with_labels(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, domain, "doc_id", bound).where("_label is not null")
    marked, _ = materialize(marked.select("text", F.col("_label").cast("int")), "mixing-labelled")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((domains, BUCKETS), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, bucket, row, _ in _words(batch, 0):
                at, word = _present(bucket, row, BUCKETS)
                counts += np.bincount(label[lo:hi][at] * BUCKETS + word, minlength=domains * BUCKETS).reshape(domains, BUCKETS)
        d, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(b), pa.array(counts[d, b])], names=["domain", "bucket", "n"])

    counts = np.zeros((domains, BUCKETS))
    for r in marked.mapInArrow(count, "domain long, bucket long, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.domain, r.bucket] = r.n  # a row for each domain and bucket at most
    chosen = uneven(counts)
    slots = np.full(BUCKETS, -1, np.int64)
    slots[chosen] = np.arange(len(chosen))

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = np.zeros((batch.num_rows, FEATURES), np.uint8)
            for lo, _, row, feature, _ in _of_features(batch, 0, slots):
                has[lo + row, feature] = 1
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in np.packbits(has, axis=1)], pa.binary())], names=["label", "bits"])

    rows = sorted((r.label, bytes(r.bits)) for r in marked.mapInArrow(bits, "label int, bits binary").collect())  # bound rows at most
    if not rows:
        return DomainModel(np.zeros((domains, FEATURES)), slots, np.zeros(domains), 0)
    has = np.unpackbits(np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    weights, offsets = softmax_regression(has, np.array([d for d, _ in rows]), domains)
    return DomainModel(weights, slots, offsets, len(rows))


def posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("n_tokens", "posteriors")) -> DataFrame:
    """The columns keep (all without it), the number of words and the posteriors (array of double) under their names."""
    keep = [c for c in (keep or docs.columns) if c not in names]
    n, weights, slots, offsets = len(keep), model.weights, model.slots, model.offsets
    domains = len(offsets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, domains))
            for lo, hi, row, feature, count in _of_features(batch, n, slots):
                tokens[lo:hi] = count
                for d in range(domains):
                    p[lo:hi, d] = np.bincount(row, weights[d][feature], hi - lo)
            p += offsets
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, domains), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(tokens), lists], names=[*keep, *names])

    kinds = docs.select(*keep).schema.add(names[0], "long").add(names[1], ArrayType(DoubleType()))
    return docs.select(*keep, F.col(text_col).alias(fresh("text", docs))).mapInArrow(run, kinds)


def rate(steps: list[np.ndarray], name: str = "posteriors") -> Column:
    """The rate after the steps: from 1, each moves along the posteriors and is cut at 0."""
    r = F.lit(1.0)
    for v in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col(name)[d] * float(v[d]) for d in range(len(v))), F.lit(0.0)))
    return r


def _totals(table: DataFrame, steps: list[np.ndarray], d: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of the domains at the rates after the steps, and the Gram matrix of the rows whose rate isn't 0. The steps
    go to the tasks as numbers: written into expressions, each pass would be compiled anew."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(d), np.zeros((d, d))
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            r = np.ones(len(n))
            for v in steps:
                r = np.maximum(0.0, r - p @ v)
            total += (n * r) @ p
            live = (r > 0) * n
            gram += (p * live[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([*range(d + d * d)], pa.int32()), pa.array(np.append(total, gram))], names=["i", "x"])

    sums = np.zeros(d + d * d)
    for row in table.select("n_tokens", "posteriors").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        sums[row.i] = row.x  # d + d * d rows at most
    return sums[:d], sums[d:].reshape(d, d)


def fit_rates(table: DataFrame, targets: np.ndarray, iterations: int = 40, tolerance: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of rate() for a table of n_tokens and posteriors, and the totals they lead to. targets: tokens of each domain.

    A step is first tried in the metric of the rows that can still move both ways, which ends sooner where many rates are
    0; if the distance doesn't shrink, in that of all rows, where a projected gradient step never enlarges it.
    """
    d = len(targets)
    steps: list[np.ndarray] = []
    totals, gram = _totals(table, steps, d)
    whole, live = np.linalg.pinv(gram, rcond=1e-10), np.linalg.pinv(gram, rcond=1e-10)
    distance = lambda t: float((t - targets) @ whole @ (t - targets))
    passes = 0
    while passes < iterations:
        away = totals - targets
        if np.abs(away).max() <= tolerance * max(1.0, np.abs(targets).max()):
            break
        tries = [live @ away, whole @ away] if len(steps) else [whole @ away]
        for step in tries:
            new, gram = _totals(table, [*steps, step], d)
            passes += 1
            if step is tries[-1] or distance(new) < 0.5 * distance(totals):
                break
        settled = distance(totals) - distance(new) <= 1e-12 * (1 + distance(totals))
        steps.append(step)
        totals, live = new, np.linalg.pinv(gram, rcond=1e-10)
        if settled:
            break
    return steps, totals


@dataclass
class Mixture:
    model: DomainModel
    steps: list[np.ndarray]
    before: np.ndarray
    targets: np.ndarray
    after: np.ndarray


def fit_mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[Mixture, DataFrame]:
    """The mixture, and the table (id, n_tokens, posteriors) it was fitted to. targets: multiples of the present expected totals, in the order of the domains."""
    model = fit_domains(docs, labels, domain_of_labels() if domain is None else domain, len(targets), id_col, text_col)
    table, _ = materialize(posteriors(docs, model, text_col, [id_col]), "mixing-posteriors")
    d = len(targets)
    before = np.array(table.agg(*[F.coalesce(F.sum(F.col("posteriors")[i] * F.col("n_tokens")), F.lit(0.0)) for i in range(d)]).first(), float)
    goal = before * np.array(list(targets.values()))
    steps, after = fit_rates(table, goal) if model.labelled else ([], before)
    return Mixture(model, steps, before, goal, after), table


def apply_mixture(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text", seed: int = 23) -> DataFrame:
    """docs with each row as often as its rate says: the whole part of rate + u, with u even in [0, 1) from the id."""
    names = fresh("n_tokens", docs), fresh("posteriors", docs)
    times, copy = fresh("times", docs), fresh("copy", docs)
    scored = posteriors(docs, mixture.model, text_col, names=names)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") / float(1 << 53)
    counted = scored.withColumn(times, F.floor(rate(mixture.steps, names[1]) + u).cast("int")).where(F.col(times) > 0)
    return counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op3_soft_mixing(spark, sf_dir: str) -> DataFrame:
    mixture, table = fit_mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return table.select("doc_id", "n_tokens", *[F.col("posteriors")[i].alias(f"p_{name}") for i, name in enumerate(DOMAINS)], rate(mixture.steps).alias("rate"))
