"""A small HTTP front-end over a live session: GET /getDocumentScores?id=&text= gives the ranked documents as JSON."""

from __future__ import annotations

import json
import logging
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ranking import rank_documents
from .schemas import FEATURES, TOP
from .sources.corpus import Corpus
from .sources.files import append_metrics, stored_bytes

log = logging.getLogger(__name__)
#: Where it listens, how long a client may take, and how long running requests have at the end (fixed values).
PORT, CLIENT_SECONDS, GRACE_SECONDS = 6060, 10, 5


def as_json(ranked: DataFrame, corpus: Corpus) -> list[dict]:
    """The documents of a query in rank order, each with its metadata and features; TOP of them at most."""
    known = corpus.metadata.withColumnRenamed("doc_id", "_id")
    rows = ranked.join(known, F.col("doc_id") == F.col("_id"), "left").orderBy("rank").collect()
    said = lambda r: {"docLength": r.doc_length or 0, "timeLastUpdated": r.time_last_updated or "", "docType": r.doc_type or "", "imageCount": r.image_count or 0, "docTitle": r.doc_title or "", "URL": r.url or ""}
    return [{"docID": str(r.doc_id), "rank": r["rank"], "metadata": said(r), "features": {n: r[n] for n in FEATURES}} for r in rows]


class Scores:
    """Answers requests; independent of HTTP, so it is tested without a socket."""

    def __init__(self, spark: SparkSession, corpus: Corpus, storage: str | None = None, metrics: str | None = None, top: int = TOP):
        self.spark, self.corpus, self.storage, self.metrics, self.top = spark, corpus, storage, metrics, top

    def answer(self, target: str) -> tuple[int, object]:
        """Status and body for the path and query of a GET; an error's body is {"error": message}."""
        url = urlsplit(target)
        if url.path != "/getDocumentScores":
            return 404, {"error": "not found"}
        asked = parse_qs(url.query)
        query_id, text = (asked.get(k, [""])[0] for k in ("id", "text"))
        if not query_id or not text:
            return 400, {"error": "id and text are both needed"}
        try:
            began = time.perf_counter_ns()
            query = self.spark.createDataFrame([(query_id, text)], "query_id string, query_text string")
            found = as_json(rank_documents(query, self.corpus, self.top, with_features=True), self.corpus)
            took = time.perf_counter_ns() - began
        except Exception as why:
            log.exception("scoring failed")
            return 500, {"error": str(why).splitlines()[0] if str(why) else type(why).__name__}
        self._report(took, len(found))
        return 200, found

    def _report(self, took: int, ranked: int) -> None:
        """A metrics record; a failure is logged, as the answer is there."""
        if self.metrics is None:
            return
        try:
            size = stored_bytes(self.spark, self.storage) if self.storage else 0
            append_metrics(self.spark, {"total_storage": size, "algorithm_update_time": took, "query_data": {"num_ranked_documents": ranked, "process_time": took}}, self.metrics)
        except Exception:
            log.exception("no metrics")


def server(scores: Scores, port: int = PORT, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Not yet running; serve_forever() and shutdown() start and end it."""

    class Handler(BaseHTTPRequestHandler):
        timeout = CLIENT_SECONDS

        def do_GET(self) -> None:
            began = time.perf_counter()
            status, body = scores.answer(self.path)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)
            log.info("%s GET %s %d %.3f s", self.client_address[0], self.path, status, time.perf_counter() - began)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
