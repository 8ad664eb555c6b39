"""Packing of token sequences into fixed windows: best-fit decreasing over a segment tree of remaining capacities.

Cases: a null or empty text still has its closing id; a text of any length is cut into full windows and one rest; equal
lengths are taken in the order of (doc_id, start), so a run gives the same sequences again; repeated rows are packed
once each (rows with a null doc_id too); an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
CLOSING_ID = 0
#: Bytes of text for each group that is packed apart.
GROUP_BYTES = 16 << 20


class BestFit:
    """Open windows by remaining capacity; the tree says which capacities have any.

    Leaf c stands for "a window with c ids left"; a node is true if a leaf below it is. The tightest window for n ids is
    the first true leaf at n or beyond: one climb and one descent, log2(capacity) steps each.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, capacity: int, window: int) -> None:
        if capacity <= 0:
            return
        self.open[capacity].append(window)
        at = capacity + self.size
        while at and not self.tree[at]:
            self.tree[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window that holds need ids, with its capacity; it is no longer open afterwards."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and not (at % 2 == 0 and self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        capacity = at - self.size
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            while at and not (at < self.size and (self.tree[2 * at] or self.tree[2 * at + 1])):
                self.tree[at] = 0
                at >>= 1
        return window, capacity


def pack(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each piece; lengths must not exceed window. Longest first, ties in the given order."""
    fit, count = BestFit(window), 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        if need > window:
            raise ValueError("a piece is longer than the window; cut it first")
        if (found := fit.take(need)) is None:
            found = (count, window)
            count += 1
        sequence[i], offset[i] = found[0], window - found[1]
        fit.add(found[1] - need, found[0])
    return sequence, offset


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    ranks names the vocabulary as ranks, which encodes several times faster than the library that reads `vocabulary`,
    the same vocabulary in full; the tests hold both to the same ids. A text that holds a special token's string is
    encoded by the full vocabulary, which knows such strings.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks is not None:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each text's ids and the closing id, cut into full windows and a rest."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, ranks)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(texts):
                ids = encode(text) + closing
                n = len(ids) // 4
                for at in range(0, n, window):
                    row.append(i)
                    start.append(at)
                    length.append(min(window, n - at))
                    crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + window)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_pieces(cut: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset. The pieces are dealt by a hash into groups that are packed apart; every group wastes
    at most its last few windows, so groups should hold thousands of windows."""
    kind = dict(cut.dtypes)["doc_id"]

    def run(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, [("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        table = table.take(order)
        sequence, offset = pack(table.column("length").to_numpy(), window)
        group = table.column("_group")[0].as_py()
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence + (group << 40))).append_column("offset", pa.array(offset))

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All texts of docs, tokenised, cut and packed. Groups follow the bytes of the texts, so a run gives the same sequences
    again however the table is stored, and a small table is one group."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return pack_pieces(pieces(docs, vocabulary, ranks, id_col, text_col, window), max(1, size // GROUP_BYTES), window)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
