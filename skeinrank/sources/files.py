"""Sinks, and sources for what they wrote: Parquet, CSV and JSON."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from datetime import datetime, timezone

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEATURES, KIND, PAIR_SCHEMA


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder of spark.checkpoint.dir, removed when the application ends. Where that is unset, a single
    machine (tests) has a folder of its own; a cluster without it is an error, as its executors share no temporary folder."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="skeinrank-"))
            current = context._jsc.sc().getCheckpointDir()
        base = current.get()
    path = f"{base.rstrip('/')}/skeinrank/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the scratch folder: computed once, and there still if an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for the queries that are made and run in here."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def files_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries made and run in here leave no shuffle files behind; else they stay until the driver collects its garbage."""
    return configured(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def sent(spark: SparkSession, value: object) -> Iterator[Broadcast]:
    """value on all executors; its files go with the block, where those of a large closure would stay."""
    held = spark.sparkContext.broadcast(value)
    try:
        yield held
    finally:
        held.destroy()


def unique_name(base: str) -> str:
    """base with the time and a random part, never the same twice."""
    now = datetime.now(timezone.utc)
    return f"{base}_{now:%Y%m%d_%H%M%S}.{now.microsecond * 1000:09d}_{uuid.uuid4()}"


def save_ranked(ranked: DataFrame, folder: str) -> str:
    """Append a dump of ranked documents below folder, one part for each query; its path."""
    path = f"{folder}/{unique_name('ranked')}"
    ranked.write.partitionBy("query_id").parquet(path)
    return path


def save_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").parquet(path)


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA).parquet(path)


def csv_fields(pairs: DataFrame) -> DataFrame:
    """The fields of the CSV as text: whole numbers plain, others with six decimals."""
    kept = [c for c in pairs.columns if c not in FEATURES and c != "Y"]
    return pairs.select(*kept, *[(F.col(c).cast("string") if KIND[c] == "int" else F.expr(f"format_number(`{c}`, '0.000000')")).alias(c) for c in FEATURES], F.col("Y").cast("string").alias("Y"))


def save_csv(pairs: DataFrame, path: str) -> None:
    csv_fields(pairs.select(*FEATURES, "Y")).write.mode("overwrite").csv(path, header=True)


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA).csv(path, header=True, enforceSchema=False)


def split_columns(df: DataFrame) -> tuple[list[str], str]:
    """Feature columns and label: all but the last, and the last."""
    return df.columns[:-1], df.columns[-1]


def to_json_rows(ranked: DataFrame) -> DataFrame:
    """query_id and json: the query's documents in rank order as a JSON array. Made from at most TOP rows for each query."""
    document = F.struct("rank", F.col("doc_id").alias("docID"), "bm25")
    return ranked.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(document))).alias("json"))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below path; 0 if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(where).getLength()) if fs.exists(where) else 0


def directory_entries(spark: SparkSession, path: str) -> int:
    """Files and folders below path; 0 if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return 0
    found = fs.getContentSummary(where)
    return int(found.getFileCount() + found.getDirectoryCount()) - 1


def append_metrics(spark: SparkSession, record: dict, path: str) -> None:
    """One evaluation record more in the metrics table at path."""
    metrics_frame(spark, record).write.mode("append").parquet(path)


METRICS = "total_storage long, algorithm_update_time long, query_data struct<num_documents_parsed:long,num_ranked_documents:long,process_time:long,cache_exists:boolean>"


def metrics_frame(spark: SparkSession, record: dict) -> DataFrame:
    """Durations in nanoseconds; what is missing is zero."""
    q = record.get("query_data", {})
    row = (int(record.get("total_storage", 0)), int(record.get("algorithm_update_time", 0)), (int(q.get("num_documents_parsed", 0)), int(q.get("num_ranked_documents", 0)), int(q.get("process_time", 0)), bool(q.get("cache_exists", False))))
    return spark.createDataFrame([row], METRICS)
