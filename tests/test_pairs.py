"""Judgement files, pairs, samples, folds and positions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skeinrank.operators import linear, numbering, pairwise
from skeinrank.schemas import FEATURES, KIND, LETOR_ID
from skeinrank.sources import files, letor

R = random.Random(4)


def lines_of(n, queries):
    """Lines with all features, ids of none, repeated ids, other white space; and what they say."""
    lines, want = [], []
    for k in range(n):
        rel, qid = R.randint(0, 4), R.randint(1, queries)
        values = {name: R.choice((R.uniform(-9, 9), R.randint(-5, 50), 0)) for name in FEATURES if R.random() < 0.8}
        pairs = [(LETOR_ID[name], v) for name, v in values.items()] + [(i, 7.5) for i in (1, 2, 136)]
        R.shuffle(pairs)
        early = [(LETOR_ID[name], -1e6) for name in values if R.random() < 0.1]  # an earlier value of the same id
        lines.append(("\t" if k % 3 else "  ").join([str(rel), f"qid:{qid}", *(f"{i}:{v!r}" for i, v in early + pairs)]) + ("\r" if k % 5 == 0 else ""))
        want.append((rel, qid, *[int(values.get(name, 0)) if KIND[name] == "int" else float(values.get(name, 0)) for name in FEATURES]))
    return lines, want


def test_parse_all_features(spark, tmp_path):
    lines, want = lines_of(300, 20)
    (tmp_path / "f.txt").write_text("\n".join(lines) + "\n", newline="")
    got = letor.parse(letor.scan(spark, str(tmp_path / "f.txt"))).select("relevance", "qid", *FEATURES).collect()
    assert sorted(map(tuple, got)) == sorted(want)


BAD = {"": "fewer than two fields", "3": "fewer than two fields", "x qid:1": "relevance", "1.5 qid:1": "relevance", "1 qid=3": "qid", "1 qid:": "qid", "1 qid:3:4": "qid", "1 qid:3 1:2:3": "feature without one colon", "1 qid:3 5": "feature without one colon", "1 qid:3 a:2": "feature id", "1 qid:3 5:zz": "feature value", "1 qid:3 5:": "feature value"}
GOOD = ["0 qid:1", " 4  qid:-2 5:+1 ", "1 qid:1 110:.5 130:1e3", "1 qid:1 110:NaN 130:-inf", "1 qid:1 110:Infinity", "1 qid:1 99999999999:1"]


def test_strict_and_lenient(spark):
    table = spark.createDataFrame([(t,) for t in [*BAD, *GOOD]], "line string")
    assert {r.line: r.reason for r in letor.bad_lines(table).collect()} == BAD
    assert letor.parse(table, strict=False).count() == len(GOOD)
    for text in BAD:
        with pytest.raises(Exception, match="bad line"):
            letor.parse(spark.createDataFrame([(text,)], "line string")).count()


def judged(spark, rows):
    return spark.createDataFrame([(f"r{i}", rel, qid, float(i), i) for i, (rel, qid) in enumerate(rows)], "rid string, relevance int, qid long, BM25 double, StreamLength int")


@pytest.mark.parametrize("min_diff", [1, 2, 3, 4])
def test_pairs_are_antisymmetric(spark, min_diff):
    rows = [(R.randint(0, 4), R.randint(1, 4)) for _ in range(40)] + [(2, 99), (1, 98), (1, 98), (-3, 97), (9, 97)]
    got = {(r.i, r.j): (r.BM25, r.StreamLength, r.Y) for r in pairwise.pairs(judged(spark, rows), min_diff).collect()}
    want = {(f"r{a}", f"r{b}"): (float(a - b), a - b, -1 if x < y else 1) for a, (x, p) in enumerate(rows) for b, (y, q) in enumerate(rows) if p == q and a != b and abs(x - y) >= min_diff}
    assert got == want and all(got[j, i] == (-d, -n, -y) for (i, j), (d, n, y) in got.items())


def test_min_diff_is_checked(spark):
    for bad in (0, 5, -1):
        with pytest.raises(ValueError):
            pairwise.pairs(judged(spark, [(0, 1)]), bad)


def test_examples(spark):
    table = judged(spark, [(i % 5, i % 3) for i in range(60)])
    every = pairwise.pairs(table).collect()
    chosen = sorted(every, key=lambda r: hashlib.md5(f"42:{r.qid}:{r.i}:{r.j}".encode()).hexdigest())[:50]
    mixed = sorted(chosen, key=lambda r: hashlib.md5(f"shuffle42:{r.qid}:{r.i}:{r.j}".encode()).hexdigest())
    got = pairwise.create_examples(table, 50).orderBy("position").collect()
    assert [(r.position, r.i, r.j, r.BM25, r.StreamLength, r.Y) for r in got] == [(k, r.i, r.j, r.BM25, r.StreamLength, r.Y) for k, r in enumerate(mixed, 1)]
    assert pairwise.create_examples(table, len(every)).count() == len(every)
    with pytest.raises(pairwise.TooFewPairs, match=f"{len(every)} pairs, {len(every) + 1} asked for"):
        pairwise.create_examples(table, len(every) + 1)


def test_smallest(spark):
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3000)]
    table = spark.createDataFrame([(k,) for k in [*keys, keys[0], keys[0]]], "k string").repartition(5)
    for n, few in ((0, 10), (1, 10), (700, 10), (700, 5000), (3002, 10), (9000, 10)):
        got, have = numbering.smallest(table, "k", n, few)
        assert sorted(r.k for r in got.collect()) == sorted([*keys, keys[0], keys[0]])[:n] and have == min(n, 3002)


def test_numbered_and_folds(spark):
    for values, kind in (([f"{x:05d}" for x in R.sample(range(9000), 500)], "string"), (R.sample(range(-9000, 9000), 503), "long"), ([], "long"), ([7], "long")):
        table = spark.createDataFrame([(v,) for v in values], f"k {kind}").repartition(4)
        assert {r.k: r.position for r in numbering.numbered(table, "k").collect()} == {v: i for i, v in enumerate(sorted(values))}
    folds = {r.k: r.fold for r in linear.with_folds(spark.range(23).withColumnRenamed("id", "k"), "k", 5).collect()}
    assert [folds[i] for i in range(23)] == [min(i // 4, 4) for i in range(23)]
    split = linear.split_exact(spark.range(17).select(F.col("id").cast("string").alias("k")), "k").collect()
    assert sum(r.split == "train" for r in split) == round(17 * 0.8) and len(split) == 17


def test_csv_numbers(spark, tmp_path):
    values = [0.1234565, -1e-7, 1234567.125, 0.0, -2.5]
    table = spark.createDataFrame([(v,) for v in values], "BM25 double").select(*[F.col("BM25") if n == "BM25" else F.lit(3).cast(KIND[n]).alias(n) for n in FEATURES], F.lit(-1).alias("Y"))
    assert [r.BM25 for r in files.csv_fields(table).collect()] == ["0.123456", "-0.000000", "1234567.125000", "0.000000", "-2.500000"]
    files.save_csv(table, str(tmp_path / "c"))
    assert sorted(r.BM25 for r in files.load_csv(spark, str(tmp_path / "c")).collect()) == sorted([0.123456, 0.0, 1234567.125, 0.0, -2.5])
    files.save_pairs(table, str(tmp_path / "p"))
    assert files.load_pairs(spark, str(tmp_path / "p")).columns == [*FEATURES, "Y"]
    assert files.split_columns(table) == (list(FEATURES), "Y")
