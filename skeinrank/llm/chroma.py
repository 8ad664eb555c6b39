"""Chroma audio fingerprints: pitch-class frames, integral-image filters, packed integers, alignment by offsets and bit errors.

A recording's samples are cut into overlapping frames; each frame's spectrum is folded into twelve pitch classes. Sixteen
filters compare sums of areas of the frame-by-class image, taken from its integral image, and each comparison gives two
bits, so every place of the image has one 32-bit integer. Two recordings are aligned by the offset at which most of their
equal integers fall together, and judged by the share of differing bits there.

Search: every integer of every query at every place is indexed, and each recording is looked up whole, so no alignment
is lost to the index: all offsets of a pair at which enough integers are equal are judged. The queries come in blocks of
bounded bytes, each of which is compared with all recordings; only matches leave a task, one row for each recording.
Recordings with equal fingerprints are one class from the start.

Cases: a null or empty payload and one shorter than the filters' reach have no integers and match nothing but count as
rows; payloads of any length are read whole; silence has the integers of a flat image; rows with a null id are
fingerprinted but take no part in the search; rows that repeat an id are recordings of their own, in one class if their
payloads are equal; ties between alignments go to the smaller offset, then the smaller query class; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, join_dealt, materialize

RATE, FRAME, HOP = 8000, 256, 64
CLASSES, WIDTH = 12, 8
#: C5 to B7: a frame's bins, 31.25 Hz wide, tell semitones apart from about 525 Hz on.
LOWEST, HIGHEST = 523.25, 3951.07
#: Share of differing bits up to which recordings match. Measured on melodies of random notes of the band: copies with
#: noise of a fifth of their amplitude differ in 0.22 at most, unrelated ones (with shared notes) at their best offset in 0.28.
MOST_ERRORS = 0.25
#: Bytes of the fingerprints of the queries that are compared with all recordings at once.
QUERY_BYTES = 8 << 20
#: Bounds between the four levels of a comparison: log ratios of the two areas.
LEVELS = (-0.25, 0.0, 0.25)
#: Two bits for each level so that neighbours differ in one.
GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]]:
    """Sixteen pairs of areas (first frame, end frame, first class, end class), by rule: four kinds of split at four
    places and sizes."""
    out = []
    for i in range(16):
        kind, size = i % 4, i // 4
        low = (i * 5) % 6
        high = low + 2 + 2 * (size % 3)
        width = WIDTH - 2 * (size % 2)
        middle, half = (low + high) // 2, width // 2
        if kind == 0:  # earlier and later
            out.append(([(0, half, low, high)], [(half, width, low, high)]))
        elif kind == 1:  # lower and higher
            out.append(([(0, width, low, middle)], [(0, width, middle, high)]))
        elif kind == 2:  # crossed quarters
            out.append(([(0, half, low, middle), (half, width, middle, high)], [(0, half, middle, high), (half, width, low, middle)]))
        else:  # inner and outer
            third = width // 4
            out.append(([(third, width - third, low, high)], [(0, third, low, high), (width - third, width, low, high)]))
    return out


def pitch_classes(rate: int = RATE, frame: int = FRAME) -> np.ndarray:
    """Which class each bin of the spectrum counts for, as a matrix."""
    f = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(f), CLASSES))
    inside = np.flatnonzero((f >= LOWEST) & (f <= HIGHEST))
    out[inside, np.round(12 * np.log2(f[inside] / LOWEST)).astype(int) % CLASSES] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Frames by classes, each frame scaled to a sum of 1 (a silent one is flat)."""
    count = (len(samples) - frame) // hop + 1
    if count <= 0:
        return np.zeros((0, CLASSES))
    fold, window = pitch_classes(rate, frame), np.hanning(frame)
    out = np.empty((count, CLASSES))
    for at in range(0, count, 4096):  # a bounded part of the frames at a time
        end = min(count, at + 4096)
        cut = np.lib.stride_tricks.sliding_window_view(samples[at * hop : (end - 1) * hop + frame], frame)[::hop]
        spectrum = np.fft.rfft((cut - cut.mean(1, keepdims=True)) * window)
        out[at:end] = (spectrum.real**2 + spectrum.imag**2) @ fold
    total = out.sum(1, keepdims=True)
    return np.where(total > 1e-9, out / np.maximum(total, 1e-9), 1 / CLASSES)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """The packed integers of a frames-by-classes image."""
    count = len(image) - WIDTH + 1
    if count <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, CLASSES + 1))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    area = lambda a: total[a[1] : a[1] + count, a[3]] - total[a[0] : a[0] + count, a[3]] - total[a[1] : a[1] + count, a[2]] + total[a[0] : a[0] + count, a[2]]
    out = np.zeros(count, np.uint32)
    for one, other in filters():
        # Sums are rounded, as an integral image carries the errors of all that is before.
        x, y = (np.round(sum(area(a) for a in areas), 9) for areas in (one, other))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(LEVELS, np.log((x + 0.01) / (y + 0.01)), "right")]
    return out


def offsets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct differences of a place in a and one in b, and how many pairs have each."""
    if len(a) * len(b) <= 1 << 16:
        return np.unique(np.subtract.outer(a, b), return_counts=True)
    low, size = int(a.min()) - int(b.max()), int(np.ptp(a)) + int(np.ptp(b)) + 1
    x, y = np.zeros(int(np.ptp(a)) + 1), np.zeros(int(np.ptp(b)) + 1)
    x[a - a.min()] = 1
    y[b.max() - b] = 1
    counts = np.rint(np.fft.irfft(np.fft.rfft(x, n := 1 << size.bit_length()) * np.fft.rfft(y, n), n)[:size]).astype(np.int64)
    at = np.flatnonzero(counts)
    return at + low, counts[at]


PRINT = "n_frames long, n_items long, fp binary, fp_crc32 long"


def fingerprints(recordings: DataFrame, id_col: str, payload_col: str, rate: int = RATE) -> DataFrame:
    """id, n_frames, n_items, fp (little-endian 32-bit integers), fp_crc32. The payload is 8-bit unsigned mono sound."""
    import zlib

    kind = dict(recordings.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, items, prints, crc = [], [], [], []
            for payload in batch.column(1):
                raw = np.frombuffer(payload.as_buffer(), np.uint8) if payload.is_valid else np.zeros(0, np.uint8)
                image = chroma((raw.astype(np.float32) - 128) / 128, rate)
                fp = fingerprint(image).astype("<u4")
                frames.append(len(image))
                items.append(len(fp))
                prints.append(fp.tobytes())
                crc.append(zlib.crc32(prints[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frames, pa.int64()), pa.array(items, pa.int64()), pa.array(prints, pa.binary()), pa.array(crc, pa.int64())], names=["id", "n_frames", "n_items", "fp", "fp_crc32"])

    return recordings.select(F.col(id_col).alias("id"), F.col(payload_col).cast("binary").alias("payload")).mapInArrow(run, f"id {kind}, {PRINT}")


def align(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Overlap and share of differing bits of b laid offset places into a."""
    lo = max(0, offset)
    n = min(len(a) - lo, len(b) - max(0, -offset))
    if n <= 0:
        return 0, 1.0
    x = a[lo : lo + n] ^ b[max(0, -offset) : max(0, -offset) + n]
    return n, float(np.bitwise_count(x).sum()) / (32 * n)


class QueryBlock:
    """The integers of some queries, in order, with the query and the place of each."""

    #: Pairs of equal integers that are held at once; a recording with more is compared with one query at a time.
    HELD = 1 << 21

    def __init__(self, names: list[int], classes: list[int], prints: list[bytes]):
        self.names, self.classes = np.array(names, np.int64), classes
        self.prints = [np.frombuffer(p, "<u4") for p in prints]
        sizes = np.array([len(p) for p in self.prints], np.int64)
        items = np.concatenate(self.prints) if prints else np.zeros(0, np.uint32)
        order = np.argsort(items, kind="stable")
        self.items, self.query = items[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        self.place = (np.arange(len(items)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]

    def peaks(self, prints: list[np.ndarray], least_hits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Recording, query, offsets with at least least_hits equal integers, and their hits."""
        at = 0
        sizes = [len(p) for p in prints]
        items = np.concatenate(prints) if prints else np.zeros(0, np.uint32)
        lows, highs = np.searchsorted(self.items, items, "left"), np.searchsorted(self.items, items, "right")
        ends = np.cumsum([0, *sizes])
        met = np.concatenate([[0], np.cumsum(highs - lows)])[ends]
        while at < len(prints):
            end = max(at + 1, int(np.searchsorted(met, met[at] + self.HELD, "right")) - 1)
            if met[end] - met[at] > self.HELD:
                yield from self._one_by_one(at, prints[at], lows[ends[at] : ends[end]], highs[ends[at] : ends[end]], least_hits)
            elif met[end] > met[at]:
                lo, n = lows[ends[at] : ends[end]], (highs - lows)[ends[at] : ends[end]]
                row = np.repeat(np.arange(at, end), sizes[at:end])
                place = np.arange(ends[at], ends[end]) - ends[row]
                found = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                pair = np.repeat(row, n) * len(self.prints) + self.query[found]
                key, hits = np.unique((pair << 32) + (self.place[found] - np.repeat(place, n) + (1 << 31)), return_counts=True)
                yield from self._grouped(key[hits >= least_hits], hits[hits >= least_hits])
            at = end

    def _grouped(self, key: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        pair, offset = key >> 32, (key & 0xFFFFFFFF) - (1 << 31)
        cuts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(pair)], strict=True):
            yield int(pair[lo]) // len(self.prints), int(pair[lo]) % len(self.prints), offset[lo:hi], hits[lo:hi]

    def _one_by_one(self, row: int, fp: np.ndarray, lows: np.ndarray, highs: np.ndarray, least_hits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """An integer that is everywhere is counted by offset, so it makes no entry for each two places."""
        known = {}
        for i in np.flatnonzero(highs > lows):
            known.setdefault(int(fp[i]), (lows[i], highs[i], []))[2].append(i)
        by_query: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lo, hi, places in known.values():
            query, place = self.query[lo:hi], self.place[lo:hi]  # in order, as the sort was stable
            cuts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            for a, b in zip(cuts, [*cuts[1:], len(query)], strict=True):
                by_query.setdefault(int(query[a]), []).append((place[a:b], np.array(places)))
        for q, both in sorted(by_query.items()):
            total = np.zeros(len(self.prints[q]) + len(fp), np.int64)
            for x, y in both:
                offset, n = offsets(x, y)
                total[offset + len(fp)] += n
            found = np.flatnonzero(total >= least_hits)
            if len(found):
                yield row, q, found - len(fp), total[found]

    def matches(self, names: np.ndarray, prints: list[np.ndarray], least_hits: int, least_overlap: int, most_errors: float) -> dict[int, list[dict]]:
        """For each recording the match of every query of another class that aligns with it."""
        out: dict[int, list[dict]] = {}
        for i, q, offset, hits in self.peaks(prints, least_hits):
            if self.names[q] == names[i]:
                continue
            a, b = self.prints[q], prints[i]
            overlap = np.minimum(len(a) - np.maximum(offset, 0), len(b) + np.minimum(offset, 0))
            offset, hits = offset[overlap >= least_overlap], hits[overlap >= least_overlap]
            for j in np.lexsort((offset, -hits)):  # the first that passes is the best
                n, errors = align(a, b, int(offset[j]))
                if errors <= most_errors:
                    out.setdefault(i, []).append({"match_class": self.classes[q], "match_offset": int(offset[j]), "match_hits": int(hits[j]), "match_overlap": n, "match_bit_errors": round(errors, 9)})
                    break
        return out


MATCH = "match_class long, match_offset long, match_hits long, match_overlap long, match_bit_errors double"


def search(prints: DataFrame, is_query: Column, most_errors: float = MOST_ERRORS, least_hits: int = 2, least_overlap: int = 8, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """prints (of fingerprints()) with class_id, the smallest id with the same fingerprint, and matches: for every class of
    queries (rows where is_query holds) but its own that aligns with it, (match_class, match_offset, match_hits,
    match_overlap, match_bit_errors). An alignment needs least_hits equal integers, an overlap of least_overlap places and
    a share of most_errors differing bits at most; of a pair's alignments the one with most hits is given, of equal ones
    that with the smaller offset. n_matches counts them, and the columns of these names beside it are the best match; null,
    and matches empty, without one. Fingerprints are told apart by their length and 96 bits of hashes."""
    spark = prints.sparkSession
    key = ["n_items", "fp_crc32", fresh("fp_hash", prints)]
    hashed = prints.withColumn(key[2], F.xxhash64("fp"))
    heard = F.col("n_items") > 0
    full = hashed.where(heard & F.col("id").isNotNull())
    classes = full.groupBy(*key).agg(F.min("id").alias("class_id"), F.max(is_query.cast("int")).alias("asked"), F.first("fp").alias("fp"), F.count("*").alias("n"))
    classes, _ = materialize(classes.withColumn("cls", F.xxhash64(*key)), "chroma-classes")

    queries = classes.where("asked = 1").select("cls", F.col("class_id").cast("long").alias("class_id"), "fp")
    # A query counts as 64 bytes at least, so the number of a block's queries is bounded too.
    blocks = -(-(queries.agg(F.sum(F.greatest(F.octet_length("fp"), F.lit(64)))).first()[0] or 0) // block_bytes)
    found = []
    for b in range(blocks):  # each block has about block_bytes, and is all that comes to the driver
        rows = queries.where(F.pmod(F.xxhash64(F.lit(3), "cls"), F.lit(blocks)) == b).collect()
        block = QueryBlock([r.cls for r in rows], [r.class_id for r in rows], [bytes(r.fp) for r in rows])

        def compare(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([(name, pa.float64() if kind == "double" else pa.int64()) for name, kind in map(str.split, MATCH.split(", "))]))
            for batch in batches:
                names, column = batch.column(0).to_numpy(), batch.column(1)
                got = block.matches(names, [np.frombuffer(fp.as_buffer(), "<u4") for fp in column], least_hits, least_overlap, most_errors)
                yield pa.RecordBatch.from_arrays([pa.array(names[list(got)] if got else [], pa.int64()), pa.array(list(got.values()), kind)], names=["cls", "found"])

        found.append(materialize(classes.select("cls", "fp").mapInArrow(compare, f"cls long, found array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>"), "chroma-matches")[0])
    known = classes.drop("fp", "asked")
    if found:
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        known = known.join(every.groupBy("cls").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("matches")), "cls", "left")
    else:
        known = known.withColumn("matches", F.lit(None).cast(f"array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>"))
    worth = lambda m: F.struct(m["match_hits"].alias("a"), (-m["match_bit_errors"]).alias("b"), (-m["match_class"]).alias("c"), m.alias("match"))
    best = F.array_max(F.transform("matches", worth))["match"]
    known, _ = materialize(known.withColumn("best", best).drop("cls"), "chroma-known")
    own = prints.columns
    joined = join_dealt(full, known, key, "id")
    fields = [f.split()[0] for f in MATCH.split(", ")]
    extra = [F.when(F.col("matches").isNull(), 0).otherwise(F.size("matches")).cast("long").alias("n_matches"), *[F.col(f"best.{f}").alias(f) for f in fields], F.coalesce("matches", F.array().cast(known.schema["matches"].dataType)).alias("matches")]
    rest = hashed.where(~heard | F.col("id").isNull()).withColumns({"class_id": F.col("id"), "matches": F.lit(None).cast(known.schema["matches"].dataType), "best": F.lit(None).cast(known.schema["best"].dataType)})
    return joined.select(*own, "class_id", *extra).unionByName(rest.select(*own, "class_id", *extra))


def op1_chroma_fingerprints(spark, sf_dir: str) -> DataFrame:
    """No table holds sound, so the UTF-8 bytes of each text serve as 8-bit samples; ids divisible by 100 are the queries."""
    prints, _ = materialize(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), "chroma-prints")
    found = search(prints, F.col("id") % 100 == 0)
    return found.select(F.col("id").alias("doc_id"), "n_frames", "n_items", "fp_crc32", "class_id", "n_matches", "match_class", "match_offset", "match_hits", "match_overlap", "match_bit_errors", "matches")
