"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts earlier go.

1. Candidates. Every window of ``length`` bytes picks the ``gram``-byte string of least hash inside
   it, a choice that depends on the window's bytes alone; consecutive windows with the same pick are
   a run. Equal windows have equal picks, so a window can only repeat where its pick does. Each task
   keeps of equal runs the earliest and marks the others at once, so a passage that is everywhere
   leaves a task once. Picks that occur once in all are done with.
2. Of equal runs (same pick, same bytes) all but the earliest are marked as a whole.
3. The earliest run of each kind goes, with its bytes, to a shard by its pick. Shards are suffix
   sorted by external induced sorting; equal windows stand together there, and all but the earliest
   are marked. For a pick with more than ``hot`` different runs, its windows are met by digest
   instead, combined in each task first, so that no shard grows with one key.
4. Marks are merged per document and cut out.

All of it is exact up to collisions of 128-bit digests; a shard holds about ``shard_bytes``.

Defined results: null text counts as empty; documents are ordered by id, nulls last, and rows that
share an id by their place in the input; an empty table gives an empty table; other columns play no
part. Texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import ship

from ._shared import materialize, parallelism
from ._text import _BASE, _INVERSE, _RANDOM, _powers, mix64, utf8
from .suffix_array import equal_starts, suffix_array

SEGMENT = 1 << 20
RUNS = "seed long, run long, o long, a long, m int, mark boolean"


class Windows:
    """Rolling hashes of one stretch of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_RANDOM[data] * _powers(_BASE, n), dtype=np.uint64, out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.back[start])

    def all_of(self, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])


def picks(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` consecutive hashes, the last of equal ones."""
    n = len(grams)
    code = (grams & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(n, dtype=np.uint64))
    padded = np.full(-(-n // width) * width + width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = code
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (np.uint64(0xFFFFFF) - (least & np.uint64(0xFFFFFF))).astype(np.int64)


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """For the runs in a stretch of whole documents: pick hash, run digest, document, start, windows."""
    n = len(data)
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return None
    w = Windows(data)
    grams = w.all_of(gram)
    pick = picks(grams, length - gram + 1)
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, offsets[long + 1] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:n], dtype=np.int8))
    p = pick[at]
    first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1))))
    a, b = at[first], at[np.concatenate((first[1:], [len(at)])) - 1]
    p = p[first]
    with np.errstate(over="ignore"):
        shape = mix64(((p - a).astype(np.uint64) << np.uint64(32)) + (b - a).astype(np.uint64))
        run = mix64(w.hashes(a, b + length) + shape)
    doc = np.searchsorted(offsets, a, "right") - 1
    return grams[p], run, doc, a - offsets[doc], (b - a + 1).astype(np.int32)


def stretches(column: pa.Array, length: int):
    """(first row, bytes, offsets, start in the first row's text) of whole documents up to SEGMENT bytes;
    a longer document comes in pieces that share length - 1 bytes."""
    if not len(column):
        return
    data, offsets = utf8(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[end])
        if hi - lo <= SEGMENT:
            yield row, data[lo:hi], offsets[row : end + 1] - lo, 0
        else:
            for at in range(lo, hi, SEGMENT):
                part = data[at : min(hi, at + SEGMENT + length - 1)]
                yield row, part, np.array([0, len(part)], np.int64), at - lo
        row = end


def _earliest(seed, run, o, a, m) -> tuple[np.ndarray, np.ndarray]:
    """An order by (seed, run, o, a), and which entries of it are not the first of their seed and run."""
    order = np.lexsort((a, o, run, seed))
    s, r = seed[order], run[order]
    later = np.zeros(len(order), bool)
    later[1:] = (s[1:] == s[:-1]) & (r[1:] == r[:-1])
    return order, later


def find_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs(o, text) -> RUNS: of equal runs in a task the earliest, and the others as marks (without their hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            orders = batch.column(0).to_numpy()
            for row, data, offsets, start in stretches(batch.column(1), length):
                found = runs_of(data, offsets, length, gram)
                if found is not None:
                    seed, digest, doc, a, m = found
                    held.append((seed, digest, orders[row + doc], a + start, m))
                    size += len(seed)
                if size > 1_000_000:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    def emit(held) -> Iterator[pa.RecordBatch]:
        seed, digest, o, a, m = (np.concatenate(x) for x in zip(*held))
        order, later = _earliest(seed, digest, o, a, m)
        for at in range(0, len(order), 100_000):
            part, mark = order[at : at + 100_000], later[at : at + 100_000]
            hashes = [pa.array(x[part].view(np.int64), mask=mark) for x in (seed, digest)]
            yield pa.RecordBatch.from_arrays(
                [*hashes, pa.array(o[part]), pa.array(a[part].astype(np.int64)), pa.array(m[part]), pa.array(mark)],
                ["seed", "run", "o", "a", "m", "mark"],
            )

    return docs.select("o", "text").mapInArrow(run, RUNS)


MARKS = "o long, a long, m long"
FINE = "kind int, seed long, other long, o long, a long, m int, body binary"


def sort_out(runs: DataFrame, hot: int) -> DataFrame:
    """runs(seed, run, o, a, m, n), partitioned by seed -> FINE rows without bytes: kind 0 marks a later
    run, 1 is an earliest run to be sorted, 2 one of a hot pick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables)
        seed, digest, o, a, m, n = (table[c].to_numpy() for c in ("seed", "run", "o", "a", "m", "n"))
        order, later = _earliest(seed, digest, o, a, m)
        s = seed[order]
        lead = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        kinds = np.repeat(np.add.reduceat(~later, lead), np.diff(np.concatenate((lead, [len(s)]))))
        busy = n[order] > hot
        kind = np.where(busy, 2, np.where(later, 0, np.where(kinds > 1, 1, -1)))
        keep = np.flatnonzero(kind >= 0)
        for at in range(0, len(keep), 100_000):
            k = keep[at : at + 100_000]
            i = order[k]
            nothing = pa.nulls(len(i))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind[k], pa.int32()), pa.array(seed[i]), nothing.cast(pa.int64()), pa.array(o[i]), pa.array(a[i]), pa.array(m[i]), nothing.cast(pa.binary())],
                [x.split()[0] for x in FINE.split(", ")],
            )

    return runs.mapInArrow(run, FINE)


def fetch_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """docs(o, text), wanted(o, runs array<struct<kind, seed, a, m>>) -> FINE: kind 1 with the run's bytes;
    kind 2 one row for each window of a hot pick (two digests, start), the earliest in its task; kind 0
    marks the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            windows: list[tuple] = []
            data, offsets = utf8(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            per = lists.value_lengths().to_numpy()
            kind, seed, a, m = (flat.field(i).to_numpy() for i in range(4))
            o = np.repeat(batch.column(0).to_numpy(), per)
            at = np.repeat(offsets[:-1], per) + a
            for i in np.flatnonzero(kind == 1):
                rows.append((1, int(seed[i]), None, int(o[i]), int(a[i]), int(m[i]), data[at[i] : at[i] + m[i] + length - 1].tobytes()))
                size += m[i] + length
                if size > 4 << 20:
                    yield _fine(rows)
                    rows, size = [], 0
            if rows:
                yield _fine(rows)
            for i in np.flatnonzero(kind == 2):
                w = Windows(data[at[i] : at[i] + m[i] + length - 1])
                one = w.all_of(length)
                two = Windows(255 - data[at[i] : at[i] + m[i] + length - 1]).all_of(length)
                windows.append((one, two, np.full(m[i], o[i]), a[i] + np.arange(m[i])))
            if windows:
                one, two, wo, wa = (np.concatenate(x) for x in zip(*windows))
                order, later = _earliest(one, two, wo, wa, None)
                for mask, k in ((later, 0), (~later, 2)):
                    for part in np.array_split(order[mask], mask.sum() // 100_000 + 1):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), k), pa.int32()), pa.array(one[part].view(np.int64)), pa.array(two[part].view(np.int64)), pa.array(wo[part]), pa.array(wa[part]), pa.array(np.ones(len(part)), pa.int32()), pa.nulls(len(part), pa.binary())],
                            [x.split()[0] for x in FINE.split(", ")],
                        )

    return docs.join(wanted, "o").select("o", "text", "runs").mapInArrow(run, FINE)


def _fine(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in FINE.split(", ")])


def sort_shards(rows: DataFrame, length: int) -> DataFrame:
    """rows(shard, o, a, m, body) -> MARKS: in every shard all but the earliest of equal windows."""

    def run(table: pa.Table) -> pa.Table:
        body = table["body"].combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        rows = np.arange(len(body))
        # a separator of least value after each run
        place = np.arange(len(data)) + np.repeat(rows, np.diff(offsets))
        text = np.zeros(len(data) + len(rows), np.int16)
        text[place] = data.astype(np.int16) + 1
        starts = offsets[:-1] + rows
        m, o, a = table["m"].to_numpy(), table["o"].to_numpy(), table["a"].to_numpy()
        inside = np.zeros(len(text) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + m, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        array = suffix_array(text, length)
        array = array[inside[array]]
        group = np.concatenate(([0], np.cumsum(~equal_starts(text, array, length))))
        row = np.searchsorted(starts, array, "right") - 1
        wo, wa = o[row], a[row] + (array - starts[row])
        order = np.lexsort((wa, wo, group))
        later = np.concatenate(([False], group[order][1:] == group[order][:-1]))
        wo, wa = spans(wo[order][later], wa[order][later])
        return pa.table({"o": wo, "a": wa[:, 0], "m": wa[:, 1]})

    return rows.groupBy("shard").applyInArrow(run, MARKS)


def spans(o: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts as (document, (first, count)) of consecutive ones."""
    order = np.lexsort((a, o))
    o, a = o[order], a[order]
    first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (a[1:] != a[:-1] + 1)))) if len(o) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((first, [len(o)])))
    return o[first], np.stack([a[first], count], axis=1)


def ordered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(o, id, text): o is the id where ids are distinct and not null, else a rank made for them."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, known, distinct = docs.agg(F.count(F.lit(1)), F.count("id"), F.count_distinct("id")).first()
    if n == known == distinct:
        return docs.withColumn("o", F.col("id"))
    docs = materialize(docs.withColumn("uid", F.monotonically_increasing_id()), "substr-docs")
    parts = parallelism(df.sparkSession)
    ranked = docs.select("id", "uid").repartitionByRange(parts, F.asc_nulls_last("id"), "uid").sortWithinPartitions(F.asc_nulls_last("id"), "uid")
    ranked = materialize(ranked.select("uid", F.monotonically_increasing_id().alias("o")), "substr-order")
    return docs.join(ranked, "uid").drop("uid")


def repeated_spans(docs: DataFrame, length: int, gram: int, hot: int, shard_bytes: int) -> DataFrame:
    """docs(o, text) -> MARKS: starts [a, a + m) of windows that also start earlier."""
    spark = docs.sparkSession
    found = materialize(find_runs(docs, length, gram), "substr-found", True)
    local = found.where("mark").select("o", "a", F.col("m").cast("long").alias("m"))
    seeds = found.where("NOT mark")
    often = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = materialize(often, "substr-seeds", True)
    runs = materialize(seeds.join(often, "seed").select("seed", "run", "o", "a", "m", "n"), "substr-runs", True)
    parts = max(parallelism(spark), math.ceil((often.where(F.col("n") <= hot).agg(F.sum("n")).first()[0] or 0) / 300_000))
    busy = runs.where(F.col("n") > hot).select(F.lit(2).alias("kind"), "seed", F.lit(None).cast("long").alias("other"), "o", "a", "m", F.lit(None).cast("binary").alias("body"))
    fine = materialize(sort_out(runs.where(F.col("n") <= hot).repartition(parts, "seed"), hot).unionByName(busy), "substr-fine", True)
    later = fine.where("kind = 0").select("o", "a", F.col("m").cast("long").alias("m"))
    wanted = fine.where("kind > 0").groupBy("o").agg(F.collect_list(F.struct("kind", "seed", "a", "m")).alias("runs"))
    bodies = materialize(fetch_bytes(docs, wanted, length), "substr-bytes", True)
    size = bodies.where("kind = 1").agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes), parallelism(spark) if size > 1 << 20 else 1)
    shard = F.pmod(F.xxhash64("seed"), F.lit(shards)).alias("shard")
    sorted_ = sort_shards(bodies.where("kind = 1").select(shard, "o", "a", "m", "body"), length)
    marks = local.unionByName(later).unionByName(sorted_)
    windows = bodies.where("kind = 2").select("seed", "other", "o", "a")
    if not windows.isEmpty():
        low = windows.groupBy("seed", "other").agg(F.min("o").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        met = windows.join(materialize(low, "substr-low", True), ["seed", "other"]).where("o > low")
        marks = marks.unionByName(met.select("o", "a", F.lit(1).cast("long").alias("m")))
        marks = marks.unionByName(bodies.where("kind = 0").select("o", "a", F.col("m").cast("long").alias("m")))
    return marks


REMOVED = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    gram: int = 32,
    hot: int = 2000,
    shard_bytes: int = 2 << 20,
    with_bytes: bool = True,
) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes)."""
    ship(df.sparkSession)
    docs = ordered(df, id_col, text_col)
    marks = repeated_spans(docs, length, gram, hot, shard_bytes)
    grouped = marks.groupBy("o").agg(F.collect_list(F.struct("a", "m")).alias("spans"))
    grouped = materialize(grouped, "substr-spans", True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out, size = [], 0
            for i, (ident, marked) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                text = data[offsets[i] : offsets[i + 1]]
                n_spans = removed = 0
                kept = text
                if marked.is_valid:
                    a, m = (marked.values.field(k).to_numpy() for k in (0, 1))
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + m + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept, removed = text[~gone], int(gone.sum())
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                raw = kept.tobytes()
                out.append((ident, len(text), removed, n_spans, hashlib.sha256(raw).hexdigest(), raw if with_bytes else None))
                size += len(raw)
                if size > 8 << 20:
                    yield _removed(out)
                    out, size = [], 0
            if out:
                yield _removed(out)

    return docs.join(grouped, "o", "left").select("id", "text", "spans").mapInArrow(cut, REMOVED)


def _removed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in REMOVED.split(", ")])
