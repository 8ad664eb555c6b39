"""MinHash near-dedup by a multi-index Hamming join.

A text's set of word shingles becomes a signature of 32 values of b = 16 bits. Signatures are split into 8 chunks of 4
values, and each chunk is indexed under every choice of its allowed errors (that many values left out). By the pigeonhole
principle two signatures whose distance is below the sum of all chunks' allowed errors plus one each have a chunk within
its own, so all pairs up to the distance limit meet in a bucket: at 17 (for 85 %) two chunks allow two errors and six
one, at 20 (for 80 %) five and three. The limit is the least distance that a pair at the similarity exceeds with a chance
below 1e-7.

Pairs that meet are confirmed on the full sets. Texts with equal sets are one class from the start. Within a bucket not
all pairs are made: its members are first compared with one of them (twice, with another member each time); classes
already connected need no further comparison, and only pairs of different components are compared after that, in blocks
bounded by rows and bytes: first by signatures alone, then those that are near another component with their texts. The
largest component of a bucket is compared with the others only, so its size costs no square. No link between components
is lost however large the bucket is, and a group whose members are at the edge of the threshold makes no row for each of
its pairs. Buckets, classes, hubs and stars that many rows share are dealt out in parts.

Cases: a null or empty text has no shingles and is linked with nothing; a text with fewer words than a shingle has its
whole word sequence as the one shingle; texts are read whole; a row with a null id is linked with nothing and has a null
component; rows that repeat an id are one document that has all of their sets, so each is linked as its own text is; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, constants, deal, fresh, join_dealt, materialize, mix, run_hashes, slices, text_buffers, word_hashes, word_spans
from .components import connected_components

SHINGLE, VALUES, CHUNKS = 5, 32, 8
SIZE = VALUES // CHUNKS
#: Members of a bucket, and bytes of their texts, that are compared at once; a larger bucket is compared block by block.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Members up to which the buckets of a batch are compared all at once.
FEW = 48


def distance_limit(similarity: float, miss: float = 1e-7) -> int:
    """The least signature distance that a pair of the similarity exceeds with a chance below miss."""
    p = 1 - similarity
    tail = lambda d: sum(comb(VALUES, i) * p**i * (1 - p) ** (VALUES - i) for i in range(d + 1, VALUES + 1))
    return next(d for d in range(VALUES + 1) if tail(d) < miss)


def index_choices(limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Chunk and left-out values of each index key, such that signatures at most limit apart share a key: the chunks'
    allowed errors and one for each chunk sum up to more than the limit."""
    spare = max(0, limit + 1 - CHUNKS)
    allowed = [spare // CHUNKS + (c < spare % CHUNKS) for c in range(CHUNKS)]
    if max(allowed) >= SIZE:
        raise ValueError(f"at a distance of {limit} a chunk would be left without a value")
    return [(c, tuple(c * SIZE + i for i in gone)) for c, errors in enumerate(allowed) for gone in combinations(range(SIZE), errors)]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    buf = LOWER[buf]
    s, e, first = word_spans(buf, offs)
    words = word_hashes(buf, s, e)
    runs = run_hashes(words, k, 23)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(runs[lo : hi - k + 1]))
        elif hi > lo:
            out.append(run_hashes(words[lo:hi], hi - lo, 29 + hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES values of 16 bits for each set that isn't empty."""
    values = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    a, b = constants(VALUES, 31), constants(VALUES, 37)
    out = np.empty((len(sets), VALUES), np.uint16)
    for i in range(VALUES):
        x = values * a[i] + b[i]
        x ^= x >> np.uint64(32)
        out[:, i] = (np.minimum.reduceat(x, first) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
    return out


def index_keys(sig: np.ndarray, limit: int) -> np.ndarray:
    """For each signature the keys of index_choices(limit)."""
    whole = (sig.astype(np.uint64) + np.uint64(1)) * constants(VALUES, 41)
    chunks = whole.reshape(len(sig), CHUNKS, SIZE).sum(2)
    choices = index_choices(limit)
    salt = constants(len(choices), 43)
    out = np.empty((len(sig), len(choices)), np.uint64)
    for k, (chunk, gone) in enumerate(choices):
        out[:, k] = mix(chunks[:, chunk] - whole[:, list(gone)].sum(1) + salt[k])
    return out


SKETCH = "doc_id long, text_hash long, n_bytes long, n_shingles long, set_a long, set_b long, sig binary"


def sketch(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, hash and bytes of the text, n_shingles, two hashes of the whole set, and the signature (null for an empty
    set) of docs(doc_id, text, text_hash)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            for lo, hi in slices(offs):
                sets = shingle_sets(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
                full = [i for i, s in enumerate(sets) if len(s)]
                a, b, sig = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), [None] * (hi - lo)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                        sig[i] = row.tobytes()
                        a[i], b[i] = mix(sets[i] + np.uint64(5)).sum().view(np.int64), mix(sets[i] ^ np.uint64(0x5DEECE66D)).sum().view(np.int64)
                numbers = (np.diff(offs[lo : hi + 1]), np.array([len(s) for s in sets], np.int64), a, b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *map(pa.array, numbers), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "n_bytes", "n_shingles", "set_a", "set_b", "sig"])

    return docs.mapInArrow(run, SKETCH)


def _sigs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, VALUES), np.uint16)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(data, np.uint16, len(column) * VALUES, first).reshape(-1, VALUES)


def _with_keys(classes: DataFrame, limit: int) -> DataFrame:
    """key, cls: every index key of every class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = index_keys(_sigs(batch.column(1)), limit).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, cls long")


def _differences(a, b):
    """Number of signature values that differ."""
    at = F.sequence(F.lit(0), F.lit(VALUES - 1))
    return F.size(F.filter(at, lambda i: F.substring(a, i * 2 + 1, F.lit(2)) != F.substring(b, i * 2 + 1, F.lit(2))))


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, and anything in common."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(one) + len(two) - both)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, k: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets. texts: cls, text. The pairs of one a
    follow its text in a stream, so a text is not copied to each pair; an a of many pairs is dealt out in parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, texts = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            good = []
            for i in range(len(a)):
                own = shingle_sets(*text_buffers(texts.slice(i, 1)), k)[0]
                if not b[i].is_valid:
                    known = own
                elif _linked(known, own, percent):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), b.take(pa.array(good, pa.int64()))], names=["a", "b"])

    firsts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt, copies = deal(pairs, firsts, ["a"], "b")
    heads = copies.join(texts.withColumnRenamed("cls", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "text", "_part")
    tails = dealt.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "b", "text", "_part")
    stream = heads.unionByName(tails).repartition("a", "_part").sortWithinPartitions("a", "_part", F.col("b").asc_nulls_first())
    return stream.select("a", "b", "text").mapInArrow(run, "a long, b long")


def _against_two(met: DataFrame, sigs: DataFrame, limit: int) -> DataFrame:
    """For each class a pair with the nearest of its buckets' chosen members, if it is near enough, and one with the
    nearest of the second ones. met: key, cls."""
    order = [F.min(F.struct(F.xxhash64(F.lit(seed), "cls").alias("o"), F.col("cls").alias("cls"))).alias(f"h{seed}") for seed in (1, 2)]
    hubs = met.groupBy("key").agg(*order, F.count("*").alias("n")).select("key", F.col("h1.cls").alias("h1"), F.col("h2.cls").alias("h2"), "n")
    hubs, _ = materialize(hubs, "minhash-hubs")
    pairs = join_dealt(met, hubs, ["key"], "cls").select("cls", F.posexplode(F.array("h1", "h2")).alias("turn", "hub")).where("cls <> hub").distinct()
    pairs, _ = materialize(pairs, "minhash-hub-pairs")
    hub_sigs = pairs.groupBy("hub").agg(F.count("*").alias("n")).join(sigs.select(F.col("cls").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    both = join_dealt(pairs.join(sigs.select("cls", "sig"), "cls"), hub_sigs, ["hub"], "cls")
    near = both.select("turn", "hub", "cls", _differences(F.col("sig"), F.col("hub_sig")).alias("d")).where(F.col("d") <= limit)
    best = near.groupBy("cls", "turn").agg(F.min(F.struct("d", "hub")).alias("m"))
    return best.select(F.col("m.hub").alias("a"), F.col("cls").alias("b")).distinct()


def _blocks(met: DataFrame, comps: DataFrame, sigs: DataFrame) -> DataFrame:
    """key, lo, hi, own, cls, component, sig: the members of buckets that hold several components, for each pair of blocks
    that they are compared in. The largest component's blocks meet those of the others only."""
    now = met.join(comps, "cls", "left").withColumn("component", F.coalesce("component", "cls")).join(sigs.select("cls", "n_bytes"), "cls")
    counts = now.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes"))
    sizes = counts.groupBy("key").agg(F.max(F.struct("rows", "bytes", "component")).alias("big"), F.sum("rows").alias("n"), F.sum("bytes").alias("bytes")).where("n > big.rows")
    parts = lambda rows, size: F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    sizes = sizes.select("key", "n", F.col("big.component").alias("big"), parts(F.col("big.rows"), F.col("big.bytes")).alias("in_big"), parts(F.col("n") - F.col("big.rows"), F.col("bytes") - F.col("big.bytes")).alias("in_rest"))
    sizes, _ = materialize(sizes, "minhash-sizes")
    rows = join_dealt(now, sizes, ["key"], "cls")
    is_big, h = F.col("component") == F.col("big"), F.xxhash64("cls")
    rows = rows.withColumn("own", F.when(is_big, F.pmod(h, F.col("in_big"))).otherwise(F.col("in_big") + F.pmod(h, F.col("in_rest"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(is_big, F.col("in_big")).otherwise(F.lit(0)), F.col("in_big") + F.col("in_rest") - 1)))
    return rows.join(sigs.select("cls", "sig"), "cls").select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cls", "component", "sig")


def _candidates(table: pa.Table, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of the lower block, with the rows of the upper one of other components that are near it and meet it in
    this bucket first."""
    own, cls, component = (table.column(c).to_numpy() for c in ("own", "cls", "component"))
    sig = _sigs(table.column("sig"))
    keys, bucket = index_keys(sig, limit), np.int64(table.column("key")[0].as_py()).view(np.uint64)
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    for i in left.tolist():
        others = right[(component[right] != component[i]) & ((cls[right] > cls[i]) if lo == hi else True)]
        others = others[(sig[others] != sig[i]).sum(1) <= limit]
        same = keys[others] == keys[i]
        yield i, others[keys[i][same.argmax(1)] == bucket]


def _near_rows(table: pa.Table, limit: int) -> np.ndarray:
    """Which rows of some whole blocks, in order, have a candidate in their block. Small blocks are compared all at once,
    by the distance of rows in the table."""
    key, lo, hi, own, component = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "own", "component"))
    sig, useful = _sigs(table.column("sig")), np.zeros(len(key), bool)
    new = np.append(True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(key)))
    for at, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        for i, others in _candidates(table.slice(at, size), limit):
            useful[at + others] = True
            useful[at + i] |= len(others) > 0
    left = np.repeat(sizes, sizes) - (np.arange(len(key)) - np.repeat(starts, sizes))  # rows of the block from each row on
    rows = np.flatnonzero((left > 1) & np.repeat(sizes <= FEW, sizes))
    firsts, seconds = [], []
    for d in range(1, FEW):
        rows = rows[left[rows] > d]
        if not len(rows):
            break
        i, j = rows, rows + d
        meet = (component[i] != component[j]) & ((own[i] != own[j]) | (lo[i] == hi[i]))
        i, j = i[meet], j[meet]
        near = (sig[i] != sig[j]).sum(1) <= limit
        firsts.append(i[near])
        seconds.append(j[near])
    if firsts and len(i := np.concatenate(firsts)):
        j = np.concatenate(seconds)
        known, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = index_keys(sig[known], limit)
        one, two = keys[place[: len(i)]], keys[place[len(i) :]]
        at = (one == two).argmax(1)
        meet = one[np.arange(len(i)), at] == key[i].view(np.uint64)
        useful[i[meet]] = useful[j[meet]] = True
    return useful


def _across(met: DataFrame, comps: DataFrame, sigs: DataFrame, texts: DataFrame, limit: int, percent: int, k: int) -> DataFrame:
    """Links (a, b) of different components by the pairs that meet in a bucket and are near enough, block by block.

    What has no near member of another component in a block is left out of it before texts are fetched; blocks come in a
    stream for that, in order, so most are compared many at a time. A block confirms on full sets itself, so no pair
    leaves it but links that connect what was not connected in the block.
    """

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            last = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
            inside = np.flatnonzero((last[0] != last[0][-1]) | (last[1] != last[1][-1]) | (last[2] != last[2][-1]))
            end = int(inside[-1]) + 1 if len(inside) else 0  # the last block may go on in the next batch
            if end:
                whole = table.slice(0, end)
                yield from whole.filter(pa.array(_near_rows(whole, limit))).combine_chunks().to_batches()
            held = table.slice(end)
        if held is not None:
            yield from held.filter(pa.array(_near_rows(held, limit))).combine_chunks().to_batches()

    columns = "key long, lo int, hi int, own int, cls long, component long, sig binary"
    stream = _blocks(met, comps, sigs).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    blocks, _ = materialize(stream.mapInArrow(near, columns), "minhash-blocks")

    def run(table: pa.Table) -> pa.Table:
        comp, text = table.column("component").to_numpy(), table.column("text").combine_chunks()
        sets: dict[int, np.ndarray] = {}

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_sets(*text_buffers(text.slice(i, 1)), k)[0]
            return sets[i]

        _, group = np.unique(comp, return_inverse=True)  # grows together as links are found
        a, b = [], []
        for i, others in _candidates(table, limit):
            for j in others.tolist():
                if group[i] != group[j] and _linked(set_of(i), set_of(j), percent):
                    a.append(comp[i])
                    b.append(comp[j])
                    group[group == group[j]] = group[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.join(texts, "cls").groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: texts whose shingle sets' intersection is at least percent / 100
    of their union are linked, and a component has the smallest id that links lead to."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    limit = distance_limit(percent / 100)
    sketches, _ = materialize(sketch(docs, k), "minhash-sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    # A class is named by the hash of its set; its signature depends on the set alone. Of its rows one serves, that of the
    # smallest id, by which its text is found again.
    one = F.min(F.struct("doc_id", "text_hash", "n_bytes", "sig")).alias("one")
    classes = full.groupBy("n_shingles", "set_a", "set_b").agg(one, F.count("*").alias("n"))
    sigs, _ = materialize(classes.select(F.col("set_a").alias("cls"), F.col("one.doc_id").alias("first"), F.col("one.text_hash").alias("text_hash"), F.col("one.n_bytes").alias("n_bytes"), F.col("one.sig").alias("sig"), "n_shingles", "set_a", "set_b", "n"), "minhash-classes")
    keys = _with_keys(sigs, limit)
    several, _ = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "minhash-keys")
    met, _ = materialize(join_dealt(keys, several, ["key"], "cls").select("key", "cls"), "minhash-buckets")
    texts = _texts(docs, sigs.join(met.select("cls").distinct(), "cls", "left_semi"))
    texts, _ = materialize(texts, "minhash-texts")
    pairs, _ = materialize(_against_two(met, sigs, limit), "minhash-pairs")
    links, _ = materialize(confirm(pairs, texts, percent, k), "minhash-links")
    stars, _ = materialize(connected_components(links).withColumnRenamed("id", "cls"), "minhash-components")
    links, _ = materialize(_across(met, stars, sigs, texts, limit, percent, k), "minhash-links")
    components = connected_components(links.unionByName(stars.select(F.col("cls").alias("a"), F.col("component").alias("b"))))
    components, _ = materialize(components.withColumnRenamed("id", "cls"), "minhash-components")
    # From names of classes to the smallest id of each component.
    placed = sigs.select("cls", "first").join(components, "cls")
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = join_dealt(placed, smallest, ["component"], "cls").select("cls", "component_id")
    known = sigs.select("n_shingles", "set_a", "set_b", "n", "cls", "first").join(named, "cls", "left").withColumn("component_id", F.coalesce("component_id", "first"))
    known, _ = materialize(known.select("n_shingles", "set_a", "set_b", "n", "component_id"), "minhash-named")
    members = join_dealt(full.select("doc_id", "n_shingles", "set_a", "set_b"), known, ["n_shingles", "set_a", "set_b"], "doc_id").select("doc_id", "n_shingles", "component_id")
    rest = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.unionByName(rest)


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cls and text of each class: that of the row of its first id with the text's hash, as an id may repeat."""
    wanted = classes.select("cls", F.col("first").alias("doc_id"), "text_hash")
    return docs.join(wanted, ["doc_id", "text_hash"]).select("cls", "text").dropDuplicates(["cls"])


def keep_first(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are linked, over any steps, with a document of a smaller id; rows with a null id stay."""
    name = fresh("gone", docs)
    gone = near_duplicates(docs, percent, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def op5_minhash_hamming(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
