"""N-gram Jaccard join with signature trees.

1. One pass over the texts turns each document into its set of word shingles, a digest of that set
   (equal sets are one class from here on) and a few partition keys.
2. Keys: shingle hashes are split by range into parts. Sets with similarity t differ in at most
   d = (1 - t) / t * size elements, and an element lies in one part, so of d + 1 parts one holds the
   same elements in both. Equal (part, content) keys therefore meet every link, whatever words are
   frequent, while unrelated documents that share a passage seldom agree on a whole part. Part counts
   go by size class; sets also speak the classes of all sizes that they may link with.
3. Classes with one key form a group around its least class. Parity signatures (one bit for each hash
   cell with an odd number of elements) bound the difference of two sets from below, and their own
   differences obey the triangle inequality. Members are taken in order of their signature's difference
   from the centre's, up to the first gap as wide as a link may be: those before it are joined to the
   centre and leave the key, for no link leads from them to those beyond, which form groups of their
   own in the next round. What is there after ``rounds`` rounds meets by key in one task, if a key has at most ``GROUP`` classes left:
   signatures are compared in blocks, and only a spanning forest comes out. Larger groups are joined
   unseen, which only makes components larger.
4. Components over these joins hold all links. Members of a component meet in one task as sets, under
   a signature tree: sorted by size, nodes carry OR-combined bitmaps and a size range; a dual
   traversal prunes node pairs by size range, by the largest possible overlap, and where all
   documents are linked already. What is left is compared exactly.
5. A component of more than ``block`` classes (or ``BLOCK_BYTES``) is dealt into blocks: links within blocks first, then
   among a few delegates of every block-local component; documents still outside the component's
   largest group are compared with all its other blocks. A cluster of near copies of any size costs
   a linear number of rows.

Defined results: null and empty texts have no shingles and link with nothing; fewer words than a
shingle make one shingle of the whole sequence; rows that share an id or repeat are rows of their
own; ids may be null (their component is the least id they reach, null if there is none); other
columns play no part; an empty table gives an empty table; thresholds of 1/2 or less are refused,
for at those a set has too few elements for a part that must agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.session import ship

from ._shared import discard, materialize, parallelism
from ._text import blocks, mix64, shingles, words
from .components import components

WORDS64 = 16  # of a bitmap: 1024 bits
GROUP = 4096  # classes of one key that are compared in one task
BLOCK_BYTES = 64 << 20  # of sets that one task of a dealt component holds on a side
BANDS = 64  # of differences from a centre, each an eighth of what a link in the size class may have


# -- sets, digests and keys ----------------------------------------------------------------------


def digest(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums of differently mixed elements, the first below 2**63."""
    with np.errstate(over="ignore"):
        one = int(mix64(values + np.uint64(0x1F83D9ABFB41BD6B)).sum(dtype=np.uint64)) & ((1 << 63) - 1)
        two = int(mix64(values ^ np.uint64(0x5BE0CD19137E2179)).sum(dtype=np.uint64))
    return one, two - (1 << 64) if two >= 1 << 63 else two


def _parts(values: np.ndarray, mixed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the non-empty parts, the sum of mixed elements in each, and how many there are."""
    part = (values >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return part[first], np.add.reduceat(mixed, first), np.diff(np.concatenate((first, [len(part)])))


@lru_cache
def part_plan(threshold: Fraction) -> tuple[int, float]:
    """(r, m): parts of m elements on average in the largest set of a class, of which those with r
    elements or more still outnumber the differences, for any size in the class. The largest such r:
    agreement on more elements says more."""
    need = 1.05 * float(1 / threshold - 1)

    def enough(r: int, m: float) -> bool:
        return (1 - sum(math.exp(-m) * m**i / math.factorial(i) for i in range(r))) / m >= need

    for r in (4, 3, 2):
        for m in np.arange(12, 1, -0.1):
            if all(enough(r, x) for x in np.linspace(m / math.sqrt(2), m, 9)):
                return r, float(m)
    return 1, 1 / (1.04 * float(1 / threshold - 1))


def class_limit(c: int) -> int:
    """Sizes of class c end here; limits grow by the square root of two."""
    return math.isqrt(1 << c) + (math.isqrt(1 << c) ** 2 < 1 << c)


def partition_keys(values: np.ndarray, threshold: Fraction) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(size class, keys, parity signature) of a sorted set, for the classes it speaks: its own and
    those of sets that are larger by up to one over the threshold.

    Two sets with at least that similarity have a class and in it a key in common: of the first d + 1
    parts with r elements or more, of whichever set gets there first, d at most differ. A set with too
    few such parts speaks all it has, and also parts with one element or more, of growing number.
    """
    size = len(values)
    p, q = threshold.numerator, threshold.denominator
    differ = size * (q - p) // p
    cls = 2 * (size - 1).bit_length()
    while cls and class_limit(cls - 1) >= size:
        cls -= 1
    classes = [cls]
    while size * q >= class_limit(classes[-1]) * p:  # a partner may be in that class
        classes.append(classes[-1] + 1)
    spoken = []
    least, mean = part_plan(threshold)
    with np.errstate(over="ignore"):
        mixed = mix64(values + np.uint64(0xCBBB9D5DC1059ED8))
        for c in classes:
            limit, keys = class_limit(c), []
            plans = chain([(least, math.ceil(limit / mean))], ((1, math.ceil(limit * (1 / float(threshold) - 1) * 1.04 * 2**i) + 3) for i in range(40)))
            for fewest, count in plans:
                number, content, per = _parts(values, mixed, count)
                full = per >= fewest
                number, content = number[full], content[full]
                keys.append(mix64(content ^ mix64((number << np.uint64(32)) + np.uint64(count)))[: differ + 1])
                if len(number) > differ:
                    break
            cells = 1 << max(6, (limit - 1).bit_length())
            odd = np.bincount((mixed & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
            spoken.append((c, np.concatenate(keys).view(np.int64), np.packbits(odd.astype(bool)).view(np.int64)))
    return spoken


def _ids_and_sets(batch: pa.RecordBatch, text: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for row, _, data, offsets in blocks(batch.column(text)):
        h, _, _, bounds = words(data, offsets)
        for i, values in enumerate(shingles(h, bounds, k)):
            yield row + i, values


DESCRIBED = "id long, n long, node long, node2 long, own boolean, c int, keys array<long>, signature array<long>"


def describe(docs: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """docs(id, text) -> DESCRIBED: one row per document with ``own`` set, and one for a second class it speaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, size = [], 0
            for row, values in _ids_and_sets(batch, 1, k):
                if not len(values):
                    rows.append((ids[row], 0, None, None, True, None, none, none))
                    continue
                one, two = digest(values)
                for at, (c, keys, signature) in enumerate(partition_keys(values, threshold)):
                    rows.append((ids[row], len(values), one, two, at == 0, c, keys, signature))
                    size += len(keys) + len(signature)
                if size > 1 << 20:
                    yield _described(rows)
                    rows, size = [], 0
            if rows:
                yield _described(rows)

    return docs.select("id", "text").mapInArrow(run, DESCRIBED)


def _described(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
    arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
    for lists in columns[6:]:
        ends = np.cumsum([0, *map(len, lists)])
        arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists))))
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in DESCRIBED.split(", ")])


def tell_apart(base: DataFrame) -> DataFrame:
    """DESCRIBED with ``raw`` (the digest) and a ``node`` that differs where the second digest does."""
    base = base.withColumn("raw", F.col("node"))
    twice = base.where("n > 0 AND own").groupBy(F.col("raw").alias("same")).agg(F.min("node2").alias("one"), F.max("node2").alias("two"))
    twice = materialize(twice.where("one < two").select("same"), "join-twice")
    if twice.isEmpty():
        return base
    told = base.join(twice, base["raw"] == twice["same"], "left")
    other = F.xxhash64("raw", "node2").bitwiseAND((1 << 63) - 1)
    return materialize(told.withColumn("node", F.when(F.col("same").isNotNull(), other).otherwise(F.col("node"))).drop("same"), "join-told")


def candidate_edges(base: DataFrame, threshold: Fraction, rounds: int) -> DataFrame:
    """DESCRIBED -> (u, v) between classes, such that every link's ends are connected."""
    known = base.where("n > 0")
    spoken = known.select(F.explode("keys").alias("key"), "c", "node")
    met = spoken.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    met = materialize(met.select("key"), "join-keys", True)
    rows = materialize(spoken.join(met, "key").distinct(), "join-met", True)
    discard(met)
    signatures = materialize(known.select("node", "c", "n", "signature").dropDuplicates(["node", "c"]), "join-signatures")
    p, q = threshold.numerator, threshold.denominator
    edges = signatures.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    signatures = signatures.withColumn("limit", F.ceil(F.pow(F.lit(2.0), F.col("c") / 2)))  # class_limit
    for _ in range(rounds):
        low = rows.groupBy("key", "c").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "c", "low")
        low = materialize(low, "join-low")
        around = rows.join(low, ["key", "c"]).where("node > low")
        a = signatures.select("node", "c", "limit", "n", F.col("signature").alias("s_a"))
        b = signatures.select(F.col("node").alias("low"), "c", F.col("signature").alias("s_b"), F.col("n").alias("n_low"))
        pairs = around.select("c", "node", "low").distinct().join(a, ["node", "c"]).join(b, ["low", "c"])
        odd = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        band = F.least(F.lit(BANDS - 1), F.floor(odd * (8 * p) / (F.col("limit") * (q - p)))).cast("int")
        most = F.greatest("n", "n_low") * 8 / F.col("limit")
        far = materialize(pairs.select("c", "node", "low", band.alias("band"), most.alias("most")), "join-far", True)
        apart = materialize(around.join(far, ["c", "node", "low"]).select("key", "c", "node", "low", "band", "most"), "join-apart", True)
        # differences from a centre obey the triangle inequality: beyond an empty stretch as wide as a link's
        # largest difference nothing links with what is before it. Few groups have one, and written apart from
        # the sums, so that a key with most of the rows can be split where it meets its group's.
        bounds = apart.groupBy("key", "c").agg(F.collect_set("band").alias("bands"), F.max("most").alias("most"), F.max("band").alias("top"))
        inner = F.aggregate(F.array_sort("bands"), F.lit(0), lambda s, x: F.when(x - s - 1 >= F.col("most"), s).otherwise(x))
        gaps = materialize(bounds.select("key", "c", "top", inner.alias("inner")).where("inner < top").drop("top"), "join-gaps")
        told = apart.join(gaps, ["key", "c"], "left")
        near = told.where("inner IS NULL OR band <= inner").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct()
        edges = edges.unionByName(materialize(near, "join-near"))
        left = materialize(told.where("band > inner").select("key", "c", "node"), "join-left", True)
        discard(low, far, apart, gaps, rows)
        rows = left
        if rows.isEmpty():
            return edges
    sizes = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low")).where("size > 1")
    rest = materialize(rows.join(materialize(sizes, "join-sizes"), ["key", "c"]), "join-rest")
    seen = rest.where(F.col("size") <= GROUP).join(signatures, ["node", "c"])
    n = rest.count()
    tasks = max(parallelism(base.sparkSession), n // 20_000)
    seen = seen.select(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task"), "key", "node", "n", "signature")
    unseen = rest.where((F.col("size") > GROUP) & (F.col("node") > F.col("low"))).select(F.col("node").alias("u"), F.col("low").alias("v"))
    return edges.unionByName(unseen).unionByName(_forest(seen, p, q))


def _forest(rows: DataFrame, p: int, q: int) -> DataFrame:
    """rows(task, key, node, n, signature) -> (u, v): a spanning forest of the near classes of each key."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("node", "ascending")])
        key, node, n = (table[c].to_numpy() for c in ("key", "node", "n"))
        lists = table["signature"].combine_chunks()
        ends = lists.offsets.to_numpy()
        words_ = lists.values.to_numpy().view(np.uint64)
        u, v = [], []
        for at in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
            if len(at) < 2:
                continue
            signs = np.stack([words_[ends[i] : ends[i + 1]] for i in at])
            left = np.arange(len(at))
            label = np.arange(len(at))
            for x in left[:-1]:
                other = left[x + 1 :]
                other = other[label[other] != label[x]]
                if not len(other):
                    continue
                size, large = np.minimum(n[at[x]], n[at[other]]), np.maximum(n[at[x]], n[at[other]])
                odd = np.bitwise_count(signs[other] ^ signs[x]).sum(axis=1).astype(np.int64)
                for y in other[(size * q >= large * p) & (odd * p <= size * (q - p))]:
                    if label[y] != label[x]:
                        u.append(node[at[y]])
                        v.append(node[at[x]])
                        label[label == label[y]] = label[x]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("task").applyInArrow(run, "u long, v long")


# -- the signature tree --------------------------------------------------------------------------


def bitmap(values: np.ndarray) -> tuple[np.ndarray, int]:
    """A bit for every element's hash, and the most elements on one bit."""
    bit = (values >> np.uint64(17)) % np.uint64(64 * WORDS64)
    per = np.bincount(bit.astype(np.int64), minlength=64 * WORDS64)
    return np.packbits(per > 0).view(np.uint64), int(per.max())


class SignatureTree:
    """Classes sorted by size; nodes are ranges of that order, the root first, leaves of ``leaf`` classes."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, threshold: Fraction, leaf: int = 16, fan: int = 4):
        self.t, self.leaf, self.fan = threshold, leaf, fan
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.order, self.sets = np.array(order, np.int64), [sets[i] for i in order]
        self.labels = labels[self.order].copy()
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        made = [bitmap(s) for s in self.sets]
        self.bits = np.stack([m[0] for m in made])
        self.most = np.array([m[1] for m in made], np.int64)
        self.ones = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int]] = {}

    def node(self, lo: int, hi: int) -> tuple[np.ndarray, int]:
        """The OR of the bitmaps in a range and the most elements that one of its sets has on one bit."""
        if (lo, hi) not in self.nodes:
            self.nodes[lo, hi] = (np.bitwise_or.reduce(self.bits[lo:hi], axis=0), int(self.most[lo:hi].max()))
        return self.nodes[lo, hi]

    def needed(self, a, b):
        """The least overlap with which sizes a and b reach the threshold."""
        p, q = self.t.numerator, self.t.denominator
        return -(-(a + b) * p // (p + q))

    def split(self, lo: int, hi: int) -> list[tuple[int, int]]:
        step = max(self.leaf, -(-(hi - lo) // self.fan))
        return [(i, min(i + step, hi)) for i in range(lo, hi, step)]

    def links(self, apart: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join what was not yet joined, as positions in the input; ``apart`` (a flag per
        class) restricts the search to pairs that have a flagged side."""
        flags = None if apart is None else apart[self.order]
        found: list[tuple[int, int]] = []
        stack = [((0, len(self.sets)), (0, len(self.sets)))] if len(self.sets) > 1 else []
        while stack:
            a, b = stack.pop()
            if flags is not None and not (flags[a[0] : a[1]].any() or flags[b[0] : b[1]].any()):
                continue
            label = self.labels[a[0]]
            if (self.labels[a[0] : a[1]] == label).all() and (self.labels[b[0] : b[1]] == label).all():
                continue
            if a != b:
                small, large = self.sizes[a[1] - 1], self.sizes[b[0]]  # a comes first, so its sets are the smaller ones
                if small * self.t.denominator < large * self.t.numerator:
                    continue
                (bits_a, most_a), (bits_b, most_b) = self.node(*a), self.node(*b)
                overlap = int(np.bitwise_count(bits_a & bits_b).sum()) * min(most_a, most_b)
                if overlap < self.needed(self.sizes[a[0]], self.sizes[b[0]]):
                    continue
            if max(a[1] - a[0], b[1] - b[0]) <= self.leaf:
                self._leaves(a, b, found)
                continue
            left, right = self.split(*a), self.split(*b)
            stack += [(x, y) for x in reversed(left) for y in reversed(right) if a != b or x <= y]
        return found

    def _leaves(self, a: tuple[int, int], b: tuple[int, int], found: list[tuple[int, int]]) -> None:
        at, bt = slice(*a), slice(*b)
        common = np.bitwise_count(self.bits[at, None] & self.bits[None, bt]).sum(axis=2).astype(np.int64)
        sa, sb = self.sizes[at, None], self.sizes[None, bt]
        most = np.minimum(sa - (self.ones[at, None] - common), sb - (self.ones[None, bt] - common))
        for i, j in np.argwhere(most >= self.needed(sa, sb)):
            x, y = a[0] + int(i), b[0] + int(j)
            if x >= y and a == b or self.labels[x] == self.labels[y]:
                continue
            if shared(self.sets[x], self.sets[y]) >= self.needed(int(self.sizes[x]), int(self.sizes[y])):
                found.append((int(self.order[x]), int(self.order[y])))
                self.labels[self.labels == max(self.labels[x], self.labels[y])] = min(self.labels[x], self.labels[y])

    def result(self) -> np.ndarray:
        out = np.empty_like(self.labels)
        out[self.order] = self.labels
        return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


# -- components of candidates --------------------------------------------------------------------

SETS = "node long, comp long, shingles binary"


def gather_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """docs(id, text), members(rep, node, raw, node2, comp) -> one row per class: node, comp, its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, comps, raw, second = (batch.column(i).to_pylist() for i in range(1, 5))
            rows, size = [], 0
            for row, values in _ids_and_sets(batch, 0, k):
                if len(values) and digest(values) == (raw[row], second[row]):
                    rows.append((nodes[row], comps[row], values.tobytes()))
                    size += values.nbytes
                    if size > 8 << 20:
                        yield _sets(rows)
                        rows, size = [], 0
            if rows:
                yield _sets(rows)

    joined = docs.join(members.hint("merge"), F.col("id").eqNullSafe(F.col("rep")))  # members grow with the corpus
    return joined.select("text", "node", "comp", "raw", "node2").mapInArrow(run, SETS)


def _sets(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["node", "comp", "shingles"])


def _verify(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """sets(task, comp, node, label, apart, shingles) -> (node, label) after links inside (task, comp)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("comp", "ascending"), ("node", "ascending")])
        comp, node = table["comp"].to_numpy(), table["node"].to_numpy()
        label, apart = table["label"].to_numpy(), table["apart"].to_numpy()
        raw = table["shingles"]
        new = np.concatenate(([True], (comp[1:] != comp[:-1]) | (node[1:] != node[:-1]))) if len(comp) else np.zeros(0, bool)
        keep = np.flatnonzero(new)
        nodes, labels = [], []
        for group in np.split(keep, np.flatnonzero(np.diff(comp[keep])) + 1):
            values = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in group]
            tree = SignatureTree(values, label[group], threshold)
            tree.links(None if apart[group].all() else apart[group])
            nodes.append(node[group])
            labels.append(tree.result())
        return pa.table({"node": np.concatenate(nodes), "label": np.concatenate(labels)})

    return sets.groupBy("task").applyInArrow(run, "node long, label long")


def link(sets: DataFrame, threshold: Fraction, block: int) -> DataFrame:
    """sets(node, comp, shingles) -> (node, label): nodes linked through any chain share a label."""
    spark = sets.sparkSession
    counts = materialize(sets.groupBy("comp").agg(F.count_distinct("node").alias("classes"), F.sum(F.octet_length("shingles")).alias("bytes")), "join-counts")
    total = counts.agg(F.sum("bytes")).first()[0]
    if total is None:
        return spark.createDataFrame([], "node long, label long")
    tasks = max(parallelism(spark), math.ceil(total / (8 << 20)))
    parts = F.greatest(F.ceil(F.col("classes") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sized = sets.join(materialize(counts.select("comp", parts.alias("parts")), "join-parts"), "comp")
    own = F.when(F.col("parts") > 1, F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("comp"), F.lit(tasks)))
    start = sized.select(own.alias("task"), "comp", "node", F.col("node").alias("label"), F.lit(True).alias("apart"), "shingles")
    local = materialize(_verify(start, threshold), "join-local")
    if counts.where(parts > 1).isEmpty():
        return local
    return _link_blocks(sized.where("parts > 1"), local, threshold, block)


def _link_blocks(large: DataFrame, local: DataFrame, threshold: Fraction, block: int) -> DataFrame:
    """Links between the blocks of large components, given the links within them."""
    nodes = materialize(large.select("node", "comp", "parts").distinct().join(local, "node"), "join-large")
    # delegates: of every block-local label the few nodes of least hash
    hashed = F.xxhash64("node", F.lit(7))
    slot = F.pmod(hashed, F.lit(8))
    chosen = nodes.groupBy("comp", "label", slot.alias("slot")).agg(F.min(F.struct(hashed.alias("h"), "node")).alias("pick"))
    chosen = materialize(chosen.select("comp", F.col("pick.node").alias("node")), "join-chosen")
    picked = large.join(chosen.select("node"), "node").join(local, "node")
    # few delegates, of a component that hangs together, meet in one task; many are dealt out again by label
    most = picked.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / (8 * block)).alias("a"), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES).alias("b"))
    picked = picked.join(materialize(most.select("comp", F.greatest("a", "b").alias("tables")), "join-tables"), "comp")
    group = F.xxhash64("comp", F.pmod(F.xxhash64("label"), F.col("tables")))
    picked = picked.select(group.alias("task"), "comp", "node", "label", F.lit(True).alias("apart"), "shingles")
    second = materialize(_verify(picked, threshold), "join-delegates")
    edges = local.select(F.col("node").alias("u"), F.col("label").alias("v"))
    merged = components(edges.unionByName(second.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    current = nodes.drop("label").join(merged, "node", "left")
    current = materialize(current.select("node", nodes["comp"], "parts", F.coalesce(merged["comp"], F.col("node")).alias("label")), "join-current")
    # documents outside their component's largest group meet every block of it
    groups = current.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n"))
    main = groups.groupBy("comp").agg(F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    main = materialize(main.select("comp", F.col("m.label").alias("main")), "join-main")
    if main.isEmpty():
        return local.join(current.select("node", F.col("label").alias("final")), "node", "left").select("node", F.coalesce("final", "label").alias("label"))
    open_ = current.join(main, "comp")
    rest = open_.where("label <> main")
    weights = large.groupBy("node").agg(F.first(F.octet_length("shingles")).alias("bytes"))
    piles = rest.join(weights, "node").groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("piles"))
    piles = materialize(piles, "join-piles")
    rest = rest.join(piles, "comp")
    pile = F.pmod(F.xxhash64("node", F.lit(3)), F.col("piles")).cast("int")  # the hash of a task depends on types
    bodies = large.select("node", "shingles").dropDuplicates(["node"])
    moving = rest.withColumn("pile", pile).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    standing = open_.join(piles, "comp").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    standing = standing.withColumn("pile", F.explode(F.sequence(F.lit(0), F.col("piles") - 1)))
    columns = [F.xxhash64("comp", "part", "pile").alias("task"), "comp", "node", "label"]
    meet = moving.select(*columns, F.lit(True).alias("apart")).unionByName(standing.select(*columns, F.lit(False).alias("apart")))
    meet = meet.groupBy("task", "comp", "node", "label").agg(F.max("apart").alias("apart"))
    third = materialize(_verify(meet.join(bodies, "node").select("task", "comp", "node", "label", "apart", "shingles"), threshold), "join-rest")
    edges = edges.unionByName(third.select(F.col("node").alias("u"), F.col("label").alias("v")))
    edges = edges.unionByName(current.select(F.col("node").alias("u"), F.col("label").alias("v")))
    final = components(edges)
    return local.join(final, "node", "left").select("node", F.coalesce("comp", "node").alias("label"))


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float | str = "0.8", block: int = 1024, rounds: int = 2
) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id, node, linked`` (other classes it is joined with)."""
    ship(df.sparkSession)
    t = Fraction(str(threshold))
    if not Fraction(1, 2) < t <= 1:
        raise ValueError("partition keys need a threshold above 1/2 and at most 1")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = tell_apart(materialize(describe(docs, k, t), "join-base", True))
    candidates = components(candidate_edges(base, t, rounds))
    classes = materialize(base.where("n > 0 AND own").groupBy("node", "raw", "node2").agg(F.min("id").alias("rep")), "join-classes")
    members = materialize(classes.join(candidates, "node").select("rep", "node", "raw", "node2", "comp"), "join-members")
    sets = materialize(gather_sets(docs, members, k), "join-sets", True)
    labels = link(sets, t, block)
    # written apart, so that a component with most of the classes can be split where it meets its name
    known = materialize(members.select("rep", "node").join(labels, "node"), "join-known")
    least = materialize(known.groupBy("label").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("linked")), "join-least")
    named = known.join(least, "label").select("node", "least", (F.col("linked") - 1).alias("linked"))
    named = classes.join(named, "node", "left").select("node", F.coalesce("least", "rep").alias("least"), F.coalesce("linked", F.lit(0)).alias("linked"))
    named = materialize(named, "join-named").withColumn("n", F.lit(1))
    rows = base.where("own").select("id", F.col("n").alias("n_shingles"), "node", F.least("n", F.lit(1)).alias("n"))
    out = rows.join(named, ["node", "n"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id"))
    return out.select("id", "n_shingles", component.alias("component_id"), "node", F.coalesce("linked", F.lit(0)).alias("linked"))


def one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that stay when one document (the least id) of each component is kept.

    Rows with a null id stay; of rows that share the kept id all stay.
    """
    found = jaccard_components(df, id_col, text_col, **how)
    gone = found.where("id <> component_id").select(F.col("id").alias("__fb_gone")).distinct()
    kept = df.withColumn("__fb_id", F.col(id_col)).join(gone, F.col("__fb_id") == F.col("__fb_gone"), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
