"""Hashed maximum-entropy language model with a class-factored softmax.

A word is a path of LEVELS classes of WIDTH each (from its last two bytes, then from its hash) and
its place in the last one: P(word | history) = P(a | history) P(b | a, history) P(c | a, b, history)
P(word | a, b, c). Each level is a softmax over WIDTH classes with one weight row for each hashed
feature: the previous word, the word before it (a skip feature), and both together (an n-gram
feature), each joined with the classes above. So the history reaches the word through WIDTH ** LEVELS
classes. The last factor is the word's share (count + 0.5) of its class's mass, in which unknown words
hold one place: all these places together weigh as much as the words seen once (Good and Turing).

Size: feature rows grow with the square root of the distinct training words, and word counts with
the words themselves; neither has a cap.

Training: the words of all training documents are counted, map-side first. Weights start at zero
with class shares as bias. Training documents are dealt into ``rounds`` batches by a hash of the text;
each round sends the weights to all partitions, which return observed and expected feature counts of
its batch's documents; a token's expectation is one class drawn from the model (by a hash of the token
and its place, so reruns agree), which has the gradient's mean at a fraction of its cost. The gradient
(observed minus expected) is scaled by what was seen of a feature.
One training document in CHECK is in no batch and tells how good the weights are: training stops
where they no longer get better, and the best ones are kept.

Scoring: sparse numpy batches. Counts of the ``frequent`` most frequent words go to every task (a
fixed number of rows); all other words go through an exact join by word. The model's last factor and
the unigram base need the same sum of log10(count + 0.5) per document, so one join serves both; so
does the number of a class's tokens, which comes with the model.

Defined results: null and empty texts consist of the end token; without training documents every
count is 0 and N = V = 0, so the base is log10(1) = 0 for each token; rows that repeat an id are
scored each; null ids fall into the fold of the empty text; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import ship

from . import _sums
from ._shared import materialize
from ._text import _LOWER, blocks, mix64, words
from .quality import fold

LEVELS, WIDTH = 3, 16
LEAVES = WIDTH**LEVELS
KINDS = 3  # previous word, skip, both
END, BEGIN = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
CHUNK = 16_384  # tokens whose logits stay in a processor's cache
ONES, UP_TO = np.ones(WIDTH, np.float32), np.triu(np.ones((WIDTH, WIDTH), np.float32))
CHECK = 32


def feature_rows(distinct: int) -> int:
    """Rows for each level and kind of feature, from the number of distinct training words."""
    return 512 + math.ceil(16 * math.sqrt(distinct))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end token per document, their leaf classes, and bounds."""
    h, starts, ends, bounds = words(data, offsets)
    last = _LOWER[data[ends - 1]].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(ends - starts > 1, _LOWER[data[ends - 2]], 0).astype(np.uint64) if len(ends) else last
    with np.errstate(over="ignore"):
        top = (mix64(last * np.uint64(257) + before) % np.uint64(WIDTH - 1)).astype(np.int64) + 1  # 0 is the end token's
    below = (h >> np.uint64(20)).astype(np.int64) & (LEAVES // WIDTH - 1)
    leaf = np.insert(top * (LEAVES // WIDTH) + below, bounds[1:], 0)
    return np.insert(h, bounds[1:], END), leaf, bounds + np.arange(len(bounds))


def _histories(tokens: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """A hash for each kind of feature of every token."""
    first = bounds[:-1]
    one = np.concatenate(([BEGIN], tokens[:-1]))
    one[first] = BEGIN
    two = np.concatenate(([BEGIN], one[:-1]))
    two[first] = BEGIN
    with np.errstate(over="ignore"):
        return [mix64(one), mix64(two + np.uint64(11)), mix64(one * np.uint64(31) + two)]


class Model:
    """Weights (LEVELS, KINDS, rows, WIDTH), and biases (LEVELS, LEAVES / WIDTH, WIDTH) of which a level uses
    one row for each path above it."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias
        # most that a token's weights add to a logit; a large one could leave the range of exp
        self.wide = max(sum(float(np.abs(w).max(initial=0)) for w in level) for level in weights) > 40

    @staticmethod
    def empty(n_rows: int, masses: np.ndarray) -> Model:
        """No weights; without them a class has the share of its mass."""
        bias = np.zeros((LEVELS, LEAVES // WIDTH, WIDTH), np.float32)
        for level in range(LEVELS):
            n = masses.reshape(WIDTH**level, WIDTH, -1).sum(axis=2)
            bias[level, : len(n)] = np.log(n / n.sum(axis=1, keepdims=True))
        return Model(np.zeros((LEVELS, KINDS, n_rows, WIDTH), np.float32), bias)

    def rows(self, histories: list[np.ndarray], leaf: np.ndarray, level: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """For each token the path above a level, the weight row of each kind, and the class on the level."""
        path = leaf // WIDTH ** (LEVELS - level)
        n, half = np.uint64(self.weights.shape[2]), np.uint64(32)
        with np.errstate(over="ignore"):
            salt = mix64(path.astype(np.uint64) + np.uint64(1 + 977 * level))
            rows = [(((h ^ salt) * np.uint64(0xD6E8FEB86659FD93) >> half) * n >> half).astype(np.int64) for h in histories]
        return path, rows, leaf // WIDTH ** (LEVELS - 1 - level) % WIDTH

    def logits(self, path: np.ndarray, rows: list[np.ndarray], level: int) -> np.ndarray:
        """Natural logs of the classes' shares on a level, a row for each token, up to a common term; fit for exp."""
        z = self.bias[level].take(path, axis=0)
        for kind in range(KINDS):
            z += self.weights[level, kind].take(rows[kind], axis=0)
        if self.wide:
            z -= z.max(axis=1, keepdims=True)
        return z

    def log_leaf(self, tokens: np.ndarray, leaf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log of P(leaf class | history) of each token."""
        histories, out = _histories(tokens, bounds), np.zeros(len(tokens))
        for at in range(0, len(tokens), CHUNK):
            part = slice(at, at + CHUNK)
            for level in range(LEVELS):
                path, rows, cls = self.rows([h[part] for h in histories], leaf[part], level)
                z = self.logits(path, rows, level)
                own = z[np.arange(len(path)), cls]
                out[part] += own - np.log(np.exp(z, out=z) @ ONES)
        return out


def _train_blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for _, _, data, offsets in blocks(batch.column(0)):
            yield _tokens(data, offsets)


def count_words(texts: DataFrame) -> DataFrame:
    """texts(text) -> h, leaf, c: every word's count, a partial one for each batch of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def combine(parts):
            h, leaf, c = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            h, leaf, c = h[order], leaf[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return h[first], leaf[first], np.add.reduceat(c, first)

        for tokens, leaf, _ in _train_blocks(batches):
            if not len(tokens):
                continue
            held.append(combine([(tokens, leaf.astype(np.int32), np.ones(len(tokens), np.int64))]))
            size += len(held[-1][0])
            if size > 2_000_000:
                yield _counts(combine(held))
                held, size = [], 0
        if held:
            yield _counts(combine(held))

    return texts.mapInArrow(run, "h long, leaf int, c long").groupBy("h", "leaf").agg(F.sum("c").alias("c"))


def _counts(parts) -> pa.RecordBatch:
    h, leaf, c = parts
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(leaf, pa.int32()), pa.array(c)], ["h", "leaf", "c"])


def gradient(texts: DataFrame, model: Model, tasks: int) -> tuple[np.ndarray, float]:
    """texts(text, checks) -> observed and expected feature counts, two arrays like the weights, over the
    rows that train, and the mean log-likelihood of a token of those that check."""
    shape = (2, *model.weights.shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, told, n = np.zeros(shape, np.int32), 0.0, 0
        for batch in batches:
            checks = batch.column(1)
            for _, _, data, offsets in blocks(batch.column(0).filter(checks)):
                tokens, leaf, bounds = _tokens(data, offsets)
                told, n = told + model.log_leaf(tokens, leaf, bounds).sum(), n + len(tokens)
            for _, _, data, offsets in blocks(batch.column(0).filter(pc.invert(checks))):
                tokens, leaf, bounds = _tokens(data, offsets)
                histories, keys = _histories(tokens, bounds), draw_keys(tokens, bounds)
                for at in range(0, len(tokens), CHUNK):
                    part = slice(at, at + CHUNK)
                    _add_counts(sums, model, [h[part] for h in histories], leaf[part], keys[part])
        out = np.zeros(sums.size + _sums.SLICES, np.float32)
        out[: sums.size], out[sums.size : sums.size + 2] = sums.reshape(-1), (told, n)
        yield from _sums.parts(out)

    out = _sums.total(texts.select("text", "checks").coalesce(tasks).mapInArrow(run, _sums.SCHEMA), "float32", int(np.prod(shape)) + _sums.SLICES, math.isqrt(tasks))
    told, n = out[-_sums.SLICES :][:2]
    return out[: -_sums.SLICES].reshape(shape), float(told / max(n, 1))


def draw_keys(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each token and its place in its document."""
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    with np.errstate(over="ignore"):
        return mix64(tokens * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))


def drawn(z: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
    """A class for each row of logits, drawn by its key."""
    with np.errstate(over="ignore"):
        u = (mix64(keys + np.uint64(level + 1)) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
    c = np.exp(z) @ UP_TO  # running sums
    below = np.packbits(c <= (u * c[:, -1])[:, None]).view(np.uint16)  # WIDTH bits a row
    return np.minimum(np.bitwise_count(below), WIDTH - 1).astype(np.int64)


def _add_counts(sums: np.ndarray, model: Model, histories: list[np.ndarray], leaf: np.ndarray, keys: np.ndarray) -> None:
    for level in range(LEVELS):
        path, rows, cls = model.rows(histories, leaf, level)
        guess = drawn(model.logits(path, rows, level), keys, level)
        for kind in range(KINDS):
            for side, chosen in enumerate((cls, guess)):
                np.add.at(sums[side, level, kind].reshape(-1), rows[kind] * WIDTH + chosen, np.int32(1))


def train(texts: DataFrame, model: Model, rounds: int, tasks: int, rate: float = 0.4, ridge: float = 20.0) -> tuple[Model, list[float]]:
    """The best model over the rounds, and the mean log-likelihood of a checked token before each and at the end."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    dealt = texts.select("text", (F.pmod(key, F.lit(CHECK)) == 0).alias("checks"), F.pmod(F.shiftright(key, 20), F.lit(max(rounds, 1))).alias("batch"))
    best, told = model, []
    for turn in range(rounds + 1):
        sums, likelihood = gradient(dealt.where(F.col("checks") | (F.col("batch") == turn)), model, tasks)
        if told and likelihood < max(told):
            return best, [*told, likelihood]
        best = model
        told.append(likelihood)
        if turn < rounds:
            weights = model.weights.copy()
            for part, observed, expected in zip(*(x.reshape(-1, *weights.shape[2:]) for x in (weights, sums[0], sums[1]))):  # in place
                part += np.float32(2 * rate) * (observed - expected) / (observed + expected + np.float32(ridge))
            model = Model(weights, model.bias)
        del sums
    return best, told


PARTIAL = "uid long, id long, n_tokens long, known long, sum10 double, model double, rare array<long>, times array<int>"


def score_texts(docs: DataFrame, model: Model, shares: np.ndarray, h: np.ndarray, logs: np.ndarray) -> DataFrame:
    """docs(uid, id, text) -> PARTIAL rows. ``shares``: log10 of a leaf class's mass; ``h``: sorted
    hashes of the frequent words, ``logs``: their log10(count + 0.5). Other words are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column(2)):
                tokens, leaf, bounds = _tokens(data, offsets)
                n = len(tokens)
                told = model.log_leaf(tokens, leaf, bounds) / np.log(10) - shares[leaf]
                order = np.argsort(tokens)
                ranked = tokens[order]
                at = np.minimum(np.searchsorted(h, ranked), max(len(h) - 1, 0))
                hit = h[at] == ranked if len(h) else np.zeros(n, bool)
                value, known = np.zeros(n), np.zeros(n, np.int64)
                value[order[hit]] = logs[at[hit]]
                known[order[hit]] = 1
                lists, times, ends = [], [], [0]
                missing = known == 0
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    some, count = np.unique(tokens[lo:hi][missing[lo:hi]], return_counts=True)
                    lists.append(some)
                    times.append(count)
                    ends.append(ends[-1] + len(some))
                first = bounds[:-1]
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        batch.column(1).slice(row, end - row),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(np.add.reduceat(known, first)),
                        pa.array(np.add.reduceat(value, first)),
                        pa.array(np.add.reduceat(told, first)),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists).view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times).astype(np.int32))),
                    ],
                    [x.split()[0] for x in PARTIAL.split(", ")],
                )

    return docs.select("uid", "id", "text").mapInArrow(run, PARTIAL)


def lm_scores(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    held_fold: int = 1,
    rounds: int = 4,
    frequent: int = 1 << 19,
) -> DataFrame:
    """One row per input row: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    training = docs.where(fold(F.col("id"), folds) != held_fold).select("text")
    counts = materialize(count_words(training), "lm-counts")
    classes = counts.groupBy("leaf").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect()
    totals, kinds, once = np.zeros(LEAVES), np.zeros(LEAVES), 1
    for row in classes:  # at most LEAVES
        totals[row["leaf"]], kinds[row["leaf"]] = row["n"], row["v"]
        once += row["once"]
    n, v = int(totals.sum()), int(kinds.sum())
    unknown = once / LEAVES
    masses = totals + 0.5 * kinds + unknown
    # a task returns an array as large as the model, so it should read much more than that
    tasks = n // 12_000_000 + 1
    model, _ = train(training, Model.empty(feature_rows(v), masses), rounds, tasks)
    top = counts.orderBy(F.desc("c"), "h").limit(frequent).select("h", "c").toArrow()  # at most ``frequent`` rows
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(h)
    scored = score_texts(docs.withColumn("uid", F.monotonically_increasing_id()), model, np.log10(masses), h[order], np.log10(c[order] + 0.5))
    partial = materialize(scored, "lm-partial")
    rare = partial.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("uid", F.col("w.rare").alias("h"), F.col("w.times").alias("t"))
    found = rare.join(counts.select("h", "c"), "h", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("t")).otherwise(0)).alias("more"),
        F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("more10"),
    )
    out = partial.join(found, "uid", "left")
    sum10 = F.col("sum10") + F.coalesce("more10", F.lit(0.0))
    n_known = F.col("known") + F.coalesce("more", F.lit(0))
    return out.select(
        "id",
        (fold(F.col("id"), folds) == held_fold).alias("held_out"),
        "n_tokens",
        n_known.alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (sum10 - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))).alias("base_score"),
        (sum10 + F.col("model") + (F.col("n_tokens") - n_known) * F.lit(float(np.log10(unknown / 0.5)))).alias("score"),
    )
