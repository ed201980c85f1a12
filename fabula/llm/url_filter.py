"""URL filters: rules first, then a character language-model ratio.

Rules (host, path) fit a host and its subdomains where the path starts with the rule's; the longest
wins. URLs that a rule decides are the training data: two variable-order Markov models of bytes, one
of allowed and one of blocked URLs. Contexts of up to ORDER bytes share a hashed table whose size
grows with the training data; a byte's probability is (count + 4 p) / (seen + 4), where p is its
probability under the context that is a byte shorter (Dirichlet smoothing, order by order). A URL's
value is the difference of both log-likelihoods divided by its length. A fifth of the training URLs
is kept out of the counts and calibrates the threshold.

What the rules look at is not modelled, or the models would only repeat the rules: of a host the
longest end that is some rule's host is left out, of a path the start that the deciding rule asks
for. Only URL bytes are looked at: what is left of host and path, A-Z lower-cased.
``rule_errors`` tells how well the URLs of each rule are judged by models that know only the others.

Defined results: null URLs and those without ``://`` have an empty host and path and fit no rule;
they are scored as empty, value 0; where one class has no training URLs the other class's verdict is
given, and "allow" without any; rows that repeat are judged each; extra columns are not looked at;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.session import ship

from . import _sums
from ._shared import materialize
from ._text import mix64, stretched

ORDER = 5
PAIRS = 2  # the table of (context, byte) pairs is so many bits larger than that of contexts
BINS = 4096

Rule = tuple[str, str]  # ("example.net/en/", "allow")


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(__fb_url, locate('://', __fb_url) + 3)"))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(__fb_url, locate('://', __fb_url) + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(df: DataFrame, url_col: str, rules: Sequence[Rule]) -> DataFrame:
    """Adds __fb_host, __fb_path, __fb_rule, __fb_verdict and __fb_site (what the rules do not look at);
    the rule list is short and becomes one CASE."""
    df = df.withColumn("__fb_url", F.col(url_col).cast("string"))
    df = df.withColumns({"__fb_host": host_of(F.col("__fb_url")), "__fb_path": path_of(F.col("__fb_url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    end, start = F.lit(0), F.lit(0)
    for name, decision in sorted(rules, key=lambda r: len(r[0])):  # later ones, the longer, come outermost
        host, _, path = name.partition("/")
        within = (F.col("__fb_host") == host) | F.endswith("__fb_host", F.lit("." + host))
        fits = within & F.startswith("__fb_path", F.lit("/" + path))
        end = F.greatest(end, F.when(within, F.lit(len(host))).otherwise(0))
        start = F.when(fits, F.lit(len(path) + 1)).otherwise(start)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    rest = F.substr("__fb_host", F.lit(1), F.length("__fb_host") - end)
    lowered = F.translate(F.substr("__fb_path", start + 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"__fb_rule": rule, "__fb_verdict": verdict, "__fb_site": F.concat(rest, F.lit("/"), lowered)})


def context_bits(size: int) -> int:
    """Places for contexts, as a power of two, from the bytes of the training URLs."""
    return max(12, math.ceil(math.log2(128 * max(size, 1) ** 0.4)))


def _contexts(column: pa.Array, bits: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the table places of a byte's context and of context and byte, and URL offsets;
    the last byte of a URL is an end mark, places before its start are zero."""
    data, offsets = stretched(column)
    contexts, pairs = [], []
    start = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(len(data)) - start
    context = np.zeros(len(data), np.uint64)
    with np.errstate(over="ignore"):
        for order in range(ORDER + 1):
            if order:
                earlier = np.zeros(len(data), np.uint64)
                earlier[order:] = data[:-order] if len(data) > order else 0
                context = mix64(context * np.uint64(257) + np.where(place >= order, earlier, 0) + np.uint64(order))
            contexts.append((mix64(context + np.uint64(order)) >> np.uint64(64 - bits)).astype(np.int64))
            pairs.append((mix64(context * np.uint64(263) + data + np.uint64(1 << 20)) >> np.uint64(64 - bits - PAIRS)).astype(np.int64))
    return contexts, pairs, offsets


class Markov:
    """Two interpolated models over shared hashed tables; counts[(class, 0)] contexts, [(class, 1)] pairs."""

    def __init__(self, counts: np.ndarray, bits: int):
        counts = counts.reshape(2, -1).astype(np.float64)
        self.bits, self.context, self.pair = bits, counts[:, : 1 << bits], counts[:, 1 << bits :]

    def value(self, column: pa.Array) -> np.ndarray:
        """Log-likelihood under class 1 minus that under class 0, per byte."""
        contexts, pairs, offsets = _contexts(column, self.bits)
        sums = []
        for cls in (0, 1):
            p = np.full(len(contexts[0]), 1 / 257)
            for c, w in zip(contexts, pairs):
                seen = self.context[cls][c]
                p = (np.minimum(self.pair[cls][w], seen) + 4 * p) / (seen + 4)
            sums.append(np.add.reduceat(np.log(p), offsets[:-1]))
        return (sums[1] - sums[0]) / np.diff(offsets)


def train(known: DataFrame, bits: int, tasks: int) -> Markov:
    """known(label, site) -> both models."""
    length = (1 << bits) + (1 << bits + PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, length))
        for batch in batches:
            if not batch.num_rows:
                continue
            contexts, pairs, offsets = _contexts(batch.column(1), bits)
            label = np.repeat(batch.column(0).to_numpy(), np.diff(offsets))
            for cls in (0, 1):
                own = label == cls
                for c, w in zip(contexts, pairs):
                    np.add.at(counts[cls], c[own], 1)
                    np.add.at(counts[cls], w[own] + (1 << bits), 1)
        yield from _sums.parts(counts)

    rows = known.select("label", "site").coalesce(tasks).mapInArrow(run, _sums.SCHEMA)
    return Markov(_sums.total(rows, "float64", 2 * length, math.isqrt(tasks)), bits)


def valued(sites: DataFrame, model: Markov, keep: str) -> DataFrame:
    """sites(keep..., site last) -> the kept columns and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model.value(batch.column(batch.num_columns - 1)) if batch.num_rows else np.zeros(0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], [*batch.schema.names[:-1], "value"])

    return sites.mapInArrow(run, f"{keep}, value double")


def threshold(judged: DataFrame) -> float:
    """The value that parts the calibration URLs with the least mean error of both classes, from a histogram."""
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("value") + 4) * (BINS / 8)))).cast("int")
    rows = judged.groupBy("label", place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * BINS rows
    counts = np.zeros((2, BINS))
    for r in rows:
        counts[r["label"], r["bin"]] += r["n"]
    if not counts.sum(axis=1).all():
        return 0.0
    share = np.concatenate((np.zeros((2, 1)), np.cumsum(counts / counts.sum(axis=1, keepdims=True), axis=1)), axis=1)
    error = share[1] + 1 - share[0]  # allowed below the cut, blocked above it
    least = np.flatnonzero(error <= error.min() + 1e-12)
    return float(least[np.argmin(np.abs(least - BINS / 2))] * (8 / BINS) - 4)


def fit(known: DataFrame) -> tuple[Markov, float] | str:
    """The models and the threshold from known(label, site), or the only verdict there is."""
    sizes = {r["label"]: r["size"] for r in known.groupBy("label").agg(F.sum(F.octet_length("site") + 1).alias("size")).collect()}  # two rows at most
    if len(sizes) < 2:
        return "block" if 0 in sizes else "allow"
    size = sum(sizes.values())
    tasks = max(1, min(known.sparkSession.sparkContext.defaultParallelism, size // (1 << 22) + 1))
    held = F.pmod(F.xxhash64("site"), F.lit(5)) == 0
    model = train(known.where(~held), context_bits(size), tasks)
    return model, threshold(valued(known.where(held).select("label", "site"), model, "label int"))


def _sites(df: DataFrame, rules: Sequence[Rule], id_col: str, url_col: str) -> DataFrame:
    ship(df.sparkSession)
    ruled = with_rules(df.select(F.col(id_col).alias("__fb_id"), F.col(url_col).alias("__fb_in")), "__fb_in", rules)
    sites = ruled.select(
        F.col("__fb_id").alias("id"), F.col("__fb_host").alias("host"), F.col("__fb_path").alias("path"), F.col("__fb_rule").alias("rule"),
        F.col("__fb_verdict").alias("decided"), (F.col("__fb_verdict") == "allow").cast("int").alias("label"), F.col("__fb_site").alias("site"),
    )
    return materialize(sites, "url-sites")


def judge(df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``id, host, path, rule, verdict, value``."""
    sites = _sites(df, rules, id_col, url_col)
    fitted = fit(sites.where("decided IS NOT NULL"))
    if isinstance(fitted, str):
        return sites.select("id", "host", "path", "rule", F.coalesce("decided", F.lit(fitted)).alias("verdict"), F.lit(0.0).alias("value"))
    model, cut = fitted
    kind = sites.schema["id"].dataType.simpleString()
    out = valued(sites.drop("label"), model, f"id {kind}, host string, path string, rule string, decided string")
    value = F.when(F.col("host") == "", F.lit(0.0)).otherwise(F.col("value"))
    verdict = F.coalesce("decided", F.when(value >= cut, "allow").otherwise("block"))
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"), value.alias("value"))


def rule_errors(df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> list[tuple[str, int, int]]:
    """(rule, its URLs, how many of them get the other verdict) under models that know only the other rules' URLs."""
    known = _sites(df, rules, id_col, url_col).where("decided IS NOT NULL")
    out = []
    for name, decision in rules:
        fitted = fit(known.where(F.col("rule") != name))
        own = known.where(F.col("rule") == name)
        if isinstance(fitted, str):
            n = own.count()
            out.append((name, n, 0 if fitted == decision else n))
            continue
        wrong = F.col("value") >= fitted[1] if decision == "block" else F.col("value") < fitted[1]
        row = valued(own.select("label", "site"), fitted[0], "label int").agg(F.count(F.lit(1)), F.count_if(wrong)).first()
        out.append((name, row[0], row[1]))
    return out
