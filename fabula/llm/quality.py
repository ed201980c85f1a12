"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

1. Random indexing over all documents: every word bucket owns a sparse random index vector, and its
   context vector is the sum of the index vectors (word and shape) of the words up to two places
   away. The table has a fixed size; partitions add up their parts in two levels.
2. A document is the mean of its words' context vectors, the mean of their shapes' index vectors
   (which byte classes a word holds), and three pooled products: the squared length of its mean
   index vector, and the mean products of words one and two places apart, which repetition raises.
3. A two-layer numpy network learns from at most ``sample`` labelled documents (least hash first),
   and a temperature is fitted on a fifth of them, so that scores are probabilities.

Defined results: null and empty texts are pooled to zeros and scored like any other; without two
classes to learn from every score is the share of label 1 (0.5 without labels); labels that are
null are left out, and conflicting labels of one id are averaged; rows that repeat an id are scored
each; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.session import ship

from . import _sums
from ._shared import materialize
from ._text import blocks, give_back, words

BUCKET_BITS, DIM = 13, 32
SHAPES = 256
FEATURES = 2 * DIM + 4
BLOCK = 1 << 18  # bytes of text at a time: a word takes some hundred bytes on the way

_rng = np.random.default_rng(13)


def _index_vectors(n: int) -> np.ndarray:
    """Unit vectors with four places of plus or minus one half."""
    out = np.zeros((n, DIM), np.float32)
    for row in out:
        row[_rng.choice(DIM, 4, replace=False)] = _rng.choice([-0.5, 0.5], 4)
    return out


INDEX = _index_vectors(1 << BUCKET_BITS)
SHAPE_INDEX = _index_vectors(SHAPES)

_CLASS = np.zeros(256, np.uint8)
for _bit, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b".", b",;:", b"'\"()-", range(128, 256))):
    _CLASS[list(_bytes)] = 1 << _bit
_CLASS[[b for b in range(33, 127) if not _CLASS[b]]] = 1 << 7


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, starts, _, bounds = words(data, offsets, lower=False)
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    shape = np.bitwise_or.reduceat(_CLASS[data], starts) if len(starts) else np.zeros(0, np.uint8)
    return bucket, shape, bounds


def _pairs(bounds: np.ndarray, n: int, step: int) -> np.ndarray:
    """Words whose neighbour ``step`` places on is in the same document."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.flatnonzero(doc[step:] == doc[:-step]) if n > step else np.zeros(0, np.int64)


def context_vectors(texts: DataFrame) -> np.ndarray:
    """The random-indexing table of a one-column table of texts, rows scaled to unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BUCKET_BITS, DIM))  # in double precision: small increments still count beside large sums
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0), BLOCK):
                bucket, shape, bounds = _words(data, offsets)
                own = INDEX[bucket] + SHAPE_INDEX[shape]
                around = np.zeros_like(own)
                for step in (1, 2):
                    left = _pairs(bounds, len(bucket), step)
                    around[left] += own[left + step]
                    around[left + step] += own[left]
                if len(bucket):
                    order = np.argsort(bucket.astype(np.uint16), kind="stable")
                    ranked = bucket[order]
                    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
                    table[ranked[first]] += np.add.reduceat(around[order], first, axis=0)
        yield _sums.slices(table.astype(np.float32))
        give_back()

    table = _sums.total(texts.mapInArrow(run, _sums.SCHEMA), "float32", INDEX.size).reshape(INDEX.shape)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def pooled(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """docs(id, text) -> id, features (DIM context, DIM shape, three products, log words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, FEATURES), np.float32)
            for row, end, data, offsets in blocks(batch.column(1), BLOCK):
                bucket, shape, bounds = _words(data, offsets)
                count = np.diff(bounds)
                full = np.flatnonzero(count)
                if not len(full):
                    continue
                first, n, at = bounds[full], count[full][:, None], row + full
                own = INDEX[bucket]
                out[at, :DIM] = np.add.reduceat(table[bucket], first, axis=0) / n
                out[at, DIM : 2 * DIM] = np.add.reduceat(SHAPE_INDEX[shape], first, axis=0) / n
                mean = np.add.reduceat(own, first, axis=0) / n
                out[at, 2 * DIM] = (mean * mean).sum(axis=1)
                for step in (1, 2):
                    left = _pairs(bounds, len(bucket), step)
                    product = np.zeros(len(bucket), np.float32)
                    product[left] = (own[left] * own[left + step]).sum(axis=1)
                    out[at, 2 * DIM + step] = np.add.reduceat(product, first) / n[:, 0]
                out[at, 2 * DIM + 3] = np.log1p(n[:, 0]) / 8
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "features"])
        give_back()

    return docs.mapInArrow(run, "id long, features array<float>")


class Network:
    """features -> hidden (tanh) -> probability of label 1, with a temperature on the last step."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        cut = max(1, len(x) // 5)
        order = rng.permutation(len(x))
        held, fit = order[:cut], order[cut:] if len(x) > cut else order
        z, t = self._scaled(x[fit]), y[fit].astype(np.float64)
        sizes = (x.shape[1], hidden)
        self.w1, self.b1 = rng.normal(0, sizes[0] ** -0.5, sizes), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, hidden**-0.5, hidden), np.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3))
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w1, self.b1, self.w2, np.zeros(()))]
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
                a = np.tanh(z[at] @ self.w1 + self.b1)
                err = (_sigmoid(a @ self.w2 + self.b2) - t[at]) / len(at)
                back = np.outer(err, self.w2) * (1 - a * a)
                grads = (z[at].T @ back + 1e-4 * self.w1, back.sum(axis=0), a.T @ err + 1e-4 * self.w2, err.sum())
                step += 1
                moves = []
                for (m, v), g in zip(moments, grads):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    moves.append(0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
                self.w1 -= moves[0]
                self.b1 -= moves[1]
                self.w2 -= moves[2]
                self.b2 = self.b2 - moves[3]
        self.temperature = 1.0
        logits, truth = self.logits(x[held]), y[held]
        grid = np.geomspace(0.5, 8, 60)
        loss = [-(np.where(truth == 1, np.log(_sigmoid(logits / s) + 1e-12), np.log(1 - _sigmoid(logits / s) + 1e-12))).mean() for s in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scaled(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fold(ident: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def quality_scores(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 3,
    held_fold: int = 1,
    sample: int = 20_000,
) -> DataFrame:
    """One row per input row: ``id, held_out, score, predicted``; labels of ``held_fold`` are never used."""
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = materialize(pooled(docs, context_vectors(docs.select("text"))), "quality-features")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).dropna()
    known = known.where(fold(F.col("id"), folds) != held_fold).groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    drawn = features.join(known, "id").select("y", "features", F.xxhash64("id").alias("h")).orderBy("h", "features").limit(sample).toArrow()
    y = drawn["y"].to_numpy()
    share = float(y.mean()) if len(y) else 0.5
    if 0 < share < 1 and len(y):
        x = drawn["features"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
        score = Network(x, y).score
    else:
        score = lambda x: np.full(len(x), share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(x), pa.float64())], ["id", "score"])

    scored = features.mapInArrow(run, "id long, score double")
    return scored.select(
        "id", (fold(F.col("id"), folds) == held_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that the classifier accepts. Rows with a null id stay if any of them is accepted."""
    accepted = quality_scores(df, labels, id_col, text_col, **how).where("predicted = 1").select(F.col("id").alias("__fb_id")).distinct()
    kept = df.withColumn("__fb_key", F.col(id_col).cast("long")).join(accepted, F.expr("__fb_key <=> __fb_id"), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
