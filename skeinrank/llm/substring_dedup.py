"""Substring dedup by seed and extend: repeated runs of words, found from winnowed anchors.

Seed: of the k-word runs inside each window, the one with the smallest hash is the window's anchor, so equal windows have
equal anchors at equal places. Anchors are dealt by their hash. Extend: an anchor stands for the stretch of neighbouring
windows that chose it; where two occurrences agree on that whole stretch, all its windows repeat, and where they do not,
the stretch is compared window by window. Marked windows of one document that overlap or touch run together to maximal
repeats. Every window is decided, so the result is that of comparing all windows, up to collisions of hashes of
more than 100 bits.

Nothing grows with a group of copies: within a batch of documents only the first occurrence of a stretch is dealt out,
the others are repeats already, so a passage in a third of all documents costs a row for each batch.

Cases: a null or empty text has no words and stays as it is; texts shorter than the window lose nothing; a text of any
length is scanned whole; a row with a null id stands in no order, so it loses nothing and makes nothing repeat; rows that
repeat an id and its text count as one document and get the same result each; rows that repeat an id with other texts
are documents of their own, in the order of their checksums; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import constants, input_bytes, materialize, mix, run_hashes, slices, text_buffers, word_hashes, word_spans

WINDOW, ANCHOR = 20, 6
#: One entry of a dealt block: 32 further bits of the key, the stretch's hash, its document (id, and a checksum of the text,
#: as an id may repeat with other texts), first window and number of windows.
ENTRY = np.dtype([("key", "<u4"), ("hash", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("first", "<i4"), ("count", "<i4")])
#: Bytes of input for each bucket that anchors are dealt to; a bucket is one group of a task.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 512


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values the place of the smallest, the leftmost of equals."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def anchors(words: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Row, place, first window and window count (all but the row as word numbers of the batch) and the two hashes of
    each anchor: that of its k words and that of the stretch its windows cover."""
    n, none = len(words), np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    width = window - k + 1
    grams = run_hashes(words, k, 11)
    chosen = sliding_argmin(grams, width)  # for each window start, over document bounds too
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(row_of[: n - window + 1] == row_of[window - 1 :])  # windows within one document
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    chosen = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (np.diff(starts) != 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    place, begin = chosen[at], starts[at]
    # The stretch: from the first window's first word to the last window's last. Its words count by their place from the
    # anchor, so equal stretches around equal anchors have equal hashes.
    by, reach = constants(2 * window, 13), count + window - 1
    total = mix((place - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    for j in range(2 * window - k):
        inside = np.flatnonzero(j < reach)
        total[inside] += words[begin[inside] + j] * by[j]
    return row_of[begin], place, begin, count, grams[place], mix(total)


def _split(bucket: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """bucket, kind and entries of each block: the first occurrence of each (bucket, key, hash) has kind 0; the others
    are repeats of it, kind 1, run together to stretches."""
    order = np.lexsort((entries["first"], entries["tag"], entries["doc"], entries["hash"], entries["key"], bucket))
    bucket, entries = bucket[order], entries[order]
    same = np.zeros(len(entries), bool)
    same[1:] = (bucket[1:] == bucket[:-1]) & (entries["key"][1:] == entries["key"][:-1]) & (entries["hash"][1:] == entries["hash"][:-1])
    repeats, entries, bucket = entries[same & later(entries, same)], entries[~same], bucket[~same]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
        yield int(bucket[lo]), 0, entries[lo:hi]
    if len(repeats):
        yield int(repeats["hash"][0] % np.uint64(1 << 30)), 1, joined(repeats)


def later(entries: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether an entry starts after the first of its group (a repeated row starts at the same place)."""
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(entries))))
    return (entries["doc"] != entries["doc"][head]) | (entries["tag"] != entries["tag"][head]) | (entries["first"] != entries["first"][head])


def joined(entries: np.ndarray) -> np.ndarray:
    """Entries of the same document whose windows follow on each other or overlap, as one; only doc, tag, first and count hold."""
    entries = entries[np.lexsort((entries["first"], entries["tag"], entries["doc"]))]
    end = entries["first"].astype(np.int64) + entries["count"]
    other = (entries["doc"][1:] != entries["doc"][:-1]) | (entries["tag"][1:] != entries["tag"][:-1])
    base = np.cumsum(np.append(False, other)).astype(np.int64) << 33  # apart for each document
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(entries), bool)
    new[1:] = base[1:] + entries["first"][1:] > reach[:-1]
    heads = np.flatnonzero(new)
    out = entries[heads].copy()
    out["count"] = (reach[np.append(heads[1:], len(entries)) - 1] - base[heads] - out["first"]).astype(np.int32)
    return out


def _blocks(parts: Iterator[tuple[int, int, np.ndarray]], buckets: int) -> pa.RecordBatch:
    b, k, d = [], [], []
    for bucket, kind, entries in parts:
        b.append(bucket % buckets)
        k.append(kind)
        d.append(entries.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int8()), pa.array(d, pa.binary())], names=["bucket", "kind", "data"])


BLOCK = "bucket long, kind byte, data binary"
MARK = "doc_id long, tag long, first int, count int, open boolean"


def _deal(places: Iterator[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of what comes as (key hash, hash, doc, tag, first, count), split once for each some millions of entries."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        key, hash_, doc, tag, first, count = (np.concatenate(x) for x in zip(*held, strict=True))
        entries = np.empty(len(key), ENTRY)
        entries["key"], entries["hash"], entries["doc"], entries["tag"], entries["first"], entries["count"] = key & np.uint64(0xFFFFFFFF), hash_, doc, tag, first, count
        return _blocks(_split(((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), entries), buckets)

    for x in places:
        held.append(x)
        size += len(x[0])
        if size > 1_500_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _find_first(table: pa.Table) -> pa.Table:
    """What a bucket's blocks show: repeated stretches, and as open those first occurrences whose anchor has other stretches too."""
    kinds = table.column("kind").to_numpy()
    data = table.column("data").to_pylist()
    done = [np.frombuffer(d, ENTRY) for d, k in zip(data, kinds, strict=True) if k == 1]
    held = [np.frombuffer(d, ENTRY) for d, k in zip(data, kinds, strict=True) if k == 0]
    doc, tag, first, count, opened = [], [], [], [], []

    def put(entries: np.ndarray, is_open: bool) -> None:
        for column, value in ((doc, entries["doc"]), (tag, entries["tag"].astype(np.int64)), (first, entries["first"]), (count, entries["count"]), (opened, np.full(len(entries), is_open))):
            column.append(value)

    for entries in done:
        put(entries, False)
    if held:
        entries = np.concatenate(held)
        entries = entries[np.lexsort((entries["first"], entries["tag"], entries["doc"], entries["hash"], entries["key"]))]
        same_key = np.append(False, entries["key"][1:] == entries["key"][:-1])
        same = same_key & np.append(False, entries["hash"][1:] == entries["hash"][:-1])
        if (repeats := entries[same & later(entries, same)]).size:
            put(joined(repeats), False)
        heads = ~same
        keys = entries["key"][heads]
        several = np.append(False, keys[1:] == keys[:-1])
        several[:-1] |= several[1:]
        put(entries[heads][several], True)
    cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
    return pa.table({"doc_id": cat(doc, pa.int64()), "tag": cat(tag, pa.int64()), "first": cat(first, pa.int32()), "count": cat(count, pa.int32()), "open": cat(opened, pa.bool_())})


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """doc_id, text, parts: for each document the runs (first, count) of its windows of `window` words whose words also
    start earlier (smaller id, or earlier in the document); null without any. merge_spans() makes maximal repeats of them."""
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.crc32(F.coalesce(text_col, F.lit("")).cast("binary")).alias("tag"))
    docs = every.where("doc_id is not null")
    buckets = int(max(LEAST_BUCKETS, input_bytes(docs) // BUCKET_BYTES))

    def seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                ids, tags = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                raw, offs = text_buffers(batch.column(1))
                for lo, hi in slices(offs):
                    buf, o = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                    s, e, first = word_spans(buf, o)
                    row, _, begin, count, key, stretch = anchors(word_hashes(buf, s, e), first, window, k)
                    if len(row):
                        yield key, stretch, ids[lo:hi][row], tags[lo:hi][row], begin - first[row], count

        return _deal(found(), buckets)

    def extensions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                ids, tags = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                raw, offs = text_buffers(batch.column(1))
                lists = batch.column(3)
                for lo, hi in slices(offs):
                    buf, o = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                    s, e, first = word_spans(buf, o)
                    words = word_hashes(buf, s, e)
                    one, two = run_hashes(words, window, 17), run_hashes(words, window, 19)
                    part = lists.slice(lo, hi - lo)
                    flat = part.flatten()
                    row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                    begin, count = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
                    places = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    row = np.repeat(row, count)
                    at = places + first[row]
                    yield one[at], two[at], ids[lo:hi][row], tags[lo:hi][row], places, np.ones(len(at), np.int32)

        return _deal(found(), buckets)

    marks = docs.mapInArrow(seeds, BLOCK).groupBy("bucket").applyInArrow(_find_first, MARK)
    marks, _ = materialize(marks, "substring-marks")
    unsure = marks.where("open").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "count")).alias("parts"))
    more = docs.join(unsure, ["doc_id", "tag"]).select("doc_id", "text", "tag", "parts").mapInArrow(extensions, BLOCK).groupBy("bucket").applyInArrow(_find_first, MARK)
    repeated = marks.where("not open").unionByName(more.where("not open"))
    repeated = repeated.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "count")).alias("parts"))
    return every.join(repeated, ["doc_id", "tag"], "left").select("doc_id", "text", "parts")


def kept_digest(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (the maximal repeats as `first:words`, comma-joined)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, spans = [], [], [], []
            for text, parts in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n.append(len(words))
                merged = merge_spans(parts.values, window) if parts.is_valid else []
                gone.append(sum(hi - lo for lo, hi in merged))
                kept, at = [], 0
                for lo, hi in merged:
                    kept += words[at:lo]
                    at = hi
                digest.append(hashlib.sha256(b" ".join(kept + words[at:] if merged else words)).hexdigest())
                spans.append(",".join(f"{lo}:{hi - lo}" for lo, hi in merged))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed string")


def merge_spans(parts: pa.StructArray, window: int) -> list[tuple[int, int]]:
    """Maximal stretches of words (from, to) that stretches of windows (first, count) cover."""
    first, count = parts.field(0).to_numpy().astype(np.int64), parts.field(1).to_numpy()
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate((first + count + window - 1)[order])
    heads = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
    return list(zip(first[heads].tolist(), reach[np.append(heads[1:], len(first)) - 1].tolist(), strict=True))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return kept_digest(find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
