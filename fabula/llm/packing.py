"""Best-fit packing of documents into fixed-length sequences by the sum-of-squares rule.

A piece goes where the sum over residual gaps of (open bins with that gap) squared becomes smallest;
a new bin is opened only when no open one has room. Only counts per gap are kept for the choice, so
a placement costs O(capacity) whatever the number of bins. Pieces come longest first.

Texts are read and encoded once, where they lie; only (id, piece, length) rows move. Pieces are
dealt by hash into shards of about ``shard_rows`` pieces, each packed on its own by one task: the
number of shards follows the input, and what a shard leaves open is a fraction of a percent.

Defined results: null text is an empty document of one end token; a table without rows packs into
nothing; rows that repeat an id are packed each; ids may be null; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import ship

from ._shared import materialize
from ._tokens import Bpe

PIECES = "id long, copy long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first, which may be shorter."""
    first = (total - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """docs(id, text, copy) -> one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = Bpe.load(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            ids, copies, texts = (batch.column(i) for i in range(3))
            for ident, copy, text in zip(ids.to_pylist(), copies.to_pylist(), texts):
                raw = bpe.encode(text.as_py() or "").astype("<u4", copy=False).tobytes() + end
                for piece, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    rows.append((ident, copy, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "copy", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select("id", "copy", "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    opened, never = 0, np.int64(1) << 60
    for i, size in enumerate(lengths.tolist()):
        # placing into a gap g changes the sum by 2 (count[g - size] - count[g]) + 2, or by 1 - 2 count[g] if it fills up
        change = 2 * (count[: capacity - size] - count[size:capacity]) + 2
        if len(change):
            change[0] -= 1 + 2 * count[0]
            change[count[size:capacity] == 0] = never
            left = int(change.argmin())
            if change[left] == never:
                left = -1
        else:
            left = -1
        if left >= 0:
            bins[i] = open_bins[size + left].pop()
            offsets[i] = capacity - size - left
            count[size + left] -= 1
        else:
            bins[i], offsets[i], left = opened, 0, capacity - size
            opened += 1
        if left:
            open_bins[left].append(bins[i])
            count[left] += 1
    return bins, offsets


def pack(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    shard_rows: int = 65_536,
) -> DataFrame:
    """One row per piece: ``id, copy, piece, start, length, ids_crc32, sequence_id, offset``.

    ``copy`` tells apart rows that repeat an id.
    """
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("copy"), F.col(text_col).alias("text"))
    pieces = materialize(encode_pieces(docs, tokenizer, capacity, end_id), "pack-pieces")
    shards = max(1, round(pieces.count() / shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("copy", "piece"), F.lit(shards)))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(table["length"].to_numpy(), capacity)
        sequence = bins + (table["shard"][0].as_py() << 40)
        table = table.drop_columns(["shard"])
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("shard").applyInArrow(place, PLACED)
