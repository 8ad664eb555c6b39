"""Requests as a stream: queries that arrive in a folder are ranked batch by batch, replies and metrics are appended."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ranking import rank_documents, validate
from ..schemas import TOP
from ..sources.corpus import Corpus
from ..sources.files import append_metrics, to_json_rows

REQUEST = "queryID string, queryText string"


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """query_id and query_text of the JSON lines in the files that come into a folder."""
    return spark.readStream.schema(REQUEST).json(folder).select(F.col("queryID").alias("query_id"), F.col("queryText").alias("query_text"))


def serve(queries: DataFrame, corpus: Corpus, replies: str, checkpoint: str, metrics: str | None = None, k: int = TOP) -> StreamingQuery:
    """Ranks each micro-batch as one job and writes query_id, json and error below replies, in a folder for each batch: a
    batch that is run again after a failure replaces its own replies. A query without id or text is answered by an error."""

    def rank(batch: DataFrame, number: int) -> None:
        began = time.perf_counter_ns()
        batch = batch.persist()
        checked = validate(batch)
        found = to_json_rows(rank_documents(checked.where("is_valid").select("query_id", "query_text"), corpus, k))
        good = checked.where("is_valid").select("query_id").distinct().join(found, "query_id", "left")
        good = good.select("query_id", F.coalesce("json", F.lit("[]")).alias("json"), F.lit(None).cast("string").alias("error"))
        bad = checked.where("not is_valid").select("query_id", F.lit(None).cast("string").alias("json"), F.lit("id and text are both needed").alias("error"))
        good.unionByName(bad).write.mode("overwrite").parquet(f"{replies}/batch={number}")
        if metrics is not None:
            took = time.perf_counter_ns() - began
            append_metrics(batch.sparkSession, {"algorithm_update_time": took, "query_data": {"num_ranked_documents": batch.count(), "process_time": took}}, metrics)
        batch.unpersist()

    return queries.writeStream.foreachBatch(rank).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
