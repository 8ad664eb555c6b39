"""Command lines: `python -m skeinrank.cli datagen | train | serve`."""

from __future__ import annotations

import argparse
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation, linear, pairwise
from .schemas import FEATURES
from .sources import corpus, files, letor, models

#: The grid of penalties, folds and epochs (fixed values).
PENALTIES, FOLDS, FOLD_EPOCHS, EPOCHS = (1.0, 1.25, 1.5, 1.75, 2.0, 2.25), 5, 100, 1000


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skeinrank")
    sub = top.add_subparsers(dest="command", required=True)
    gen = sub.add_parser("datagen", help="pairwise examples from a judgement file")
    gen.add_argument("--file", required=True)
    gen.add_argument("--csv", help="folder of CSV files")
    gen.add_argument("--parquet", help="folder of Parquet files; counts if both are given")
    gen.add_argument("--example-count", type=int, default=1_000_000)
    gen.add_argument("--min-diff", type=int, default=3, choices=range(1, 5))
    fit = sub.add_parser("train", help="the linear pair model")
    fit.add_argument("--train", required=True)
    fit.add_argument("--test", required=True)
    fit.add_argument("--model", help="where the model is saved")
    serve = sub.add_parser("serve", help="the HTTP front-end")
    serve.add_argument("--tables", required=True)
    serve.add_argument("--metrics")
    serve.add_argument("--port", type=int)
    return top


def datagen(spark: SparkSession, file: str, csv: str | None, parquet: str | None, count: int, min_diff: int) -> DataFrame:
    if not csv and not parquet:
        raise SystemExit("datagen needs --csv or --parquet")
    lines = letor.scan(spark, file).withColumn("rid", F.xxhash64("line"))
    examples = pairwise.create_examples(letor.parse(lines), count, min_diff).select(*FEATURES, "Y")
    (files.save_pairs if parquet else files.save_csv)(examples, parquet or csv)
    return examples


def train(spark: SparkSession, train_path: str, test_path: str, model_path: str | None = None) -> tuple[linear.LogisticModel, float, dict[str, int]]:
    """The model of the best penalty, its accuracy on the test pairs in percent and the confusion counts."""
    rows = files.load_pairs(spark, train_path).withColumn("_o", F.md5(F.concat_ws(":", *FEATURES, "Y")))
    best, _ = linear.grid_search(rows, list(FEATURES), "_o", list(PENALTIES), FOLDS, epochs=FOLD_EPOCHS)
    model = linear.fit_together(rows, list(FEATURES), [(best, None)], epochs=EPOCHS)[0]
    if model_path:
        models.save_model(spark, model, model_path)
    counts = evaluation.confusion(files.load_pairs(spark, test_path), F.col("Y"), model.predicted())
    return model, evaluation.accuracy(counts).first().accuracy, counts.first().asDict()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "datagen" and not (args.csv or args.parquet):
        raise SystemExit("datagen needs --csv or --parquet")
    spark = spark or SparkSession.builder.appName("skeinrank").getOrCreate()
    if args.command == "datagen":
        datagen(spark, args.file, args.csv, args.parquet, args.example_count, args.min_diff)
    elif args.command == "train":
        model, accuracy, counts = train(spark, args.train, args.test, args.model)
        print("penalty", model.penalty, "bias", model.bias)
        for name, weight in zip(model.columns, model.weights, strict=True):
            print(name, weight)
        print(f"accuracy {accuracy:.2f} %", counts)
    else:
        from . import service

        scores = service.Scores(spark, corpus.corpus_from_tables(spark, args.tables), args.tables, args.metrics)
        listening = service.server(scores, args.port or service.PORT)
        thread = threading.Thread(target=listening.serve_forever, daemon=True)
        thread.start()
        try:
            thread.join()
        except KeyboardInterrupt:
            listening.shutdown()
            thread.join(service.GRACE_SECONDS)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
