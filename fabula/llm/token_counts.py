"""Edit-aware token counts: a tree over a document's pre-tokens, re-encoded only where edits touch.

A document's state is a segment tree whose leaves are its pre-tokens (characters, tokens) and whose
inner nodes are sums of both; it is kept in a table by document id and version (a hash of the text).
An edit replaces text[start:end]. Pre-tokens that end ``look`` characters or more before an edit
cannot change: the pre-token pattern looks at most two characters past a token's end, and a special
token that an edit makes or breaks begins at most its length before. From the last cut that is safe
the text is cut anew, until a cut behind the edits falls together with one of the tree; from there on
old and new pre-tokens are the same. Only new pre-tokens are encoded, and the sums above them are
updated. The tree that comes out is the state for the next edits.

Defined results: null text counts as empty (0 tokens); special tokens count one each, as the
tokenizer has it; edits of one batch are given on the text as it was, are applied in order of start,
and one that overlaps an earlier one, or lies outside, is clipped to what is left; documents without
edits keep their rows; rows that repeat an id are counted each and meet all edits of that id, and
null ids those of null; empty tables give empty tables; other columns play no part. The end token is
not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.session import ship

from ._shared import materialize
from ._tokens import PATTERN, Bpe

#: What the query's edits replace: runs of seven digits or more and mail addresses of any length.
PERSONAL = r"\d{7,}|(?<![A-Za-z0-9._+])[A-Za-z0-9._+]++@[A-Za-z0-9.]+"


class Counter:
    """Pre-tokens of texts and their token counts, with a bounded cache of short ones."""

    _loaded: dict[str, Counter] = {}

    def __init__(self, path: str, limit: int = 500_000):
        import regex

        self.bpe, self.limit = Bpe(path), limit
        self.cache = dict.fromkeys(self.bpe.special, 1)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.bpe.special, key=len, reverse=True))) or r"(?!)")
        self.look = max([2, *map(len, self.bpe.special)])

    @classmethod
    def load(cls, path: str) -> Counter:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def count(self, token: str) -> int:
        n = self.cache.get(token)
        if n is None:
            n = len(self.bpe.core.encode_ordinary(token))
            if len(self.cache) >= self.limit:
                self.cache = dict.fromkeys(self.bpe.special, 1)
            if len(token) < 64:
                self.cache[token] = n
        return n

    def split(self, text: str) -> list[str]:
        """All pre-tokens; special tokens are cut out first."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.pattern.findall(text, at, m.start())
            out.append(m.group())
            at = m.end()
        return out + self.pattern.findall(text, at)

    def cut(self, text: str, at: int) -> Iterator[str]:
        """The pre-tokens from a cut on, one by one."""
        while True:
            m = self.special.search(text, at)
            for token in self.pattern.finditer(text, at, m.start() if m else len(text)):
                yield token.group()
            if not m:
                return
            yield m.group()
            at = m.end()

    def leaves(self, tokens: list[str]) -> np.ndarray:
        """(characters, tokens) of pre-tokens."""
        n = len(tokens)
        return np.stack([np.fromiter(map(len, tokens), np.int64, n), np.fromiter(map(self.count, tokens), np.int64, n)], axis=1)


class SegmentTree:
    """Sums of (characters, tokens) in an array: node i has children 2i and 2i + 1, leaves come last."""

    def __init__(self, leaves: np.ndarray):
        self.n, self.size = len(leaves), 1 << max(1, (len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + self.n] = leaves
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def leaves(self) -> np.ndarray:
        return self.sums[self.size : self.size + self.n]

    def locate(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts; past the end (n, chars)."""
        if position >= self.chars:
            return self.n, self.chars
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if position >= start + self.sums[i, 0]:
                start += int(self.sums[i, 0])
                i += 1
        return i - self.size, start

    def replace(self, first: int, last: int, leaves: np.ndarray) -> None:
        """New leaves for [first, last): in place where there is room, and the sums above follow;
        leaves that are left over become empty. Without room the leaves move, their values stay."""
        if len(leaves) > last - first:
            old = self.leaves
            whole = np.concatenate((old[:first], leaves, old[last:]))
            self.__init__(whole[whole[:, 0] > 0])
            return
        at = self.size + first
        values = np.zeros((last - first, 2), np.int64)
        values[: len(leaves)] = leaves
        self.sums[at : at + len(values)] = values
        lo, hi = at, at + len(values) - 1
        while lo > 1 and hi >= lo:
            lo, hi = lo // 2, hi // 2
            self.sums[lo : hi + 1] = self.sums[2 * lo : 2 * hi + 2].reshape(-1, 2, 2).sum(axis=1)

    def pack(self) -> bytes:
        """Levels from the root down, each in the smallest fitting integers."""
        parts, level = [self.n.to_bytes(4, "little")], 1
        while level <= self.size:
            row = self.sums[level : 2 * level]
            kind = 0 if row.max() < 1 << 8 else 1 if row.max() < 1 << 16 else 2
            parts += [bytes([kind]), row.astype(("<u1", "<u2", "<i8")[kind]).tobytes()]
            level *= 2
        return b"".join(parts)

    @classmethod
    def unpack(cls, body: bytes) -> SegmentTree:
        tree = cls.__new__(cls)
        tree.n = int.from_bytes(body[:4], "little")
        levels, at, level = [np.zeros((1, 2), np.int64)], 4, 1
        while at < len(body):
            kind = ("<u1", "<u2", "<i8")[body[at]]
            row = np.frombuffer(body, kind, 2 * level, at + 1)
            levels.append(row.reshape(-1, 2).astype(np.int64))
            at += 1 + row.nbytes
            level *= 2
        tree.size, tree.sums = level // 2, np.concatenate(levels)
        return tree


class Document:
    """A text and the tree of its pre-tokens."""

    def __init__(self, text: str, counter: Counter, tree: SegmentTree | None = None):
        self.text, self.counter, self.reencoded = text, counter, 0
        self.tree = tree or SegmentTree(counter.leaves(counter.split(text)))

    @property
    def tokens(self) -> int:
        return self.tree.tokens

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (start, end, new) on the text as it is; re-encodes what they touch."""
        old, tree, look = self.text, self.tree, self.counter.look
        pieces, spots, at, shift = [], [], 0, 0
        for start, end, new in sorted(edits):
            start = min(max(start, at), len(old))
            end = max(min(end, len(old)), start)
            pieces += [old[at:start], new]
            shift += len(new) - (end - start)
            # the last cut that cannot move
            safe = tree.locate(max(0, start - look))[1]
            if spots and safe < spots[-1][1]:
                spots[-1] = (spots[-1][0], end, spots[-1][2], shift)
            else:
                spots.append((safe, end, shift - len(new) + (end - start), shift))
            at = end
        self.text = "".join([*pieces, old[at:]])
        for safe, end, before, after in reversed(spots):  # what is right of a spot is new already
            fresh, here, stop = [], safe + before, (tree.n, tree.chars)
            for token in self.counter.cut(self.text, here):
                fresh.append(token)
                here += len(token)
                if here - after >= end:
                    leaf, start = tree.locate(here - after)
                    if start == here - after:
                        stop = (leaf, start)
                        break
            self.reencoded += len(fresh)
            tree.replace(tree.locate(safe)[0], stop[0], self.counter.leaves(fresh))


STATE = "id long, version long, n_chars long, n_pretokens long, n_tokens long, tree binary"
CHANGED = "id long, was long, text string, n_edits int, n_reencoded long, n_chars long, n_pretokens long, n_tokens long, tree binary"
EDITS = "id long, start long, `end` long, new string"


def _version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), _version(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(field.replace("`", "").split() for field in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], list(names))


def _flushed(rows: Iterator[tuple[int, tuple]], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of about 8 MB from (bytes, row)."""
    held, size = [], 0
    for weight, row in rows:
        held.append(row)
        size += weight
        if size > 8 << 20 or len(held) >= 20_000:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def build_state(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> STATE, a row each; texts stay where they are, nothing is shuffled."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        counter = Counter.load(tokenizer)
        for batch in batches:
            for ident, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tree = Document(text.as_py() or "", counter).tree
                body = tree.pack()
                yield len(body), (ident, version, tree.chars, tree.n, tree.tokens, body)

    return _documents(docs, id_col, text_col).mapInArrow(lambda batches: _flushed(rows(batches), STATE), STATE)


def edit_state(docs: DataFrame, state: DataFrame, edits: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, their STATE and edits(id, start, end, new) -> CHANGED: the documents that have edits, with
    their new text, tree and counts. Only these meet their trees; all others are not looked at."""
    ship(docs.sparkSession)
    each = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("new").cast("string").alias("new"))
    listed = edits.groupBy(F.col("id").cast("long").alias("e_id")).agg(F.collect_list(each).alias("edits"))
    touched = _documents(docs, id_col, text_col).join(listed, F.expr("id <=> e_id")).drop("e_id")
    trees = state.select(F.col("id").alias("s_id"), F.col("version").alias("s_version"), "tree")
    trees = trees.join(listed.select("e_id"), F.expr("s_id <=> e_id"), "left_semi").dropDuplicates(["s_id", "s_version"])
    met = touched.join(trees, F.expr("id <=> s_id AND version = s_version")).select("id", "version", "text", "edits", "tree")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        counter = Counter.load(tokenizer)
        for batch in batches:
            for ident, version, text, listed, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(i) for i in (2, 3, 4))):
                document = Document(text.as_py() or "", counter, SegmentTree.unpack(body.as_py()))
                changes = [(e["start"] or 0, e["end"] or 0, e["new"] or "") for e in listed.as_py()]
                document.apply(changes)
                tree = document.tree
                body, filled = tree.pack(), int((tree.leaves[:, 0] > 0).sum())
                yield len(body) + 4 * len(document.text), (ident, version, document.text, len(changes), document.reencoded, tree.chars, filled, tree.tokens, body)

    return met.mapInArrow(lambda batches: _flushed(rows(batches), CHANGED), CHANGED)


def next_state(state: DataFrame, changed: DataFrame) -> DataFrame:
    """STATE after the edits: changed documents have their new rows, all others the ones they had."""
    gone = changed.select(F.col("id").alias("c_id"), "was").distinct()
    kept = state.join(gone, F.expr("id <=> c_id AND version = was"), "left_anti")
    new = changed.select("id", _version(F.col("text")).alias("version"), "n_chars", "n_pretokens", "n_tokens", "tree")
    return kept.unionByName(new)


def next_documents(docs: DataFrame, changed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the changed texts; other columns stay as they are."""
    new = changed.select(F.col("id").alias("__fb_id"), F.col("was").alias("__fb_was"), F.col("text").alias("__fb_text")).dropDuplicates(["__fb_id", "__fb_was"])
    keyed = docs.withColumns({"__fb_key": F.col(id_col).cast("long"), "__fb_version": _version(F.col(text_col))})
    joined = keyed.join(new, F.expr("__fb_key <=> __fb_id AND __fb_version = __fb_was"), "left")
    text = F.when(F.col("__fb_was").isNotNull(), F.col("__fb_text")).otherwise(F.col(f"`{text_col}`")).alias(text_col)
    return joined.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def redactions(docs: DataFrame, pattern: str = PERSONAL, new: str = "[removed]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """EDITS that replace every match of ``pattern``, over each distinct (id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        import re

        find = re.compile(pattern, re.ASCII).finditer
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for m in find(text.as_py() or ""):
                    yield 64, (ident, m.start(), m.end(), new)

    ship(docs.sparkSession)
    with_any = docs.where(F.rlike(F.col(text_col), F.lit(pattern))).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return with_any.mapInArrow(lambda batches: _flushed(rows(batches), EDITS), EDITS).distinct()


def redaction_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PERSONAL, new: str = "[removed]") -> DataFrame:
    """``id, n_chars, n_pretokens, n_tokens, n_edits, n_reencoded, n_tokens_after`` for the edits that
    replace every match of ``pattern``: all documents are encoded once into their state, then the
    edits go through it. Ids are taken to be distinct: rows that share one also share their edits."""
    state = materialize(build_state(docs, tokenizer, id_col, text_col), "count-state")
    touched = docs.where(F.rlike(F.col(text_col), F.lit(pattern)))
    edits = materialize(redactions(docs, pattern, new, id_col, text_col), "count-edits")
    changed = edit_state(touched, state, edits, tokenizer, id_col, text_col)
    changed = materialize(changed.select("id", "was", "n_edits", "n_reencoded", F.col("n_tokens").alias("after")).dropDuplicates(["id", "was"]), "count-changed")
    changed = changed.withColumnRenamed("id", "c_id")
    out = state.drop("tree").join(changed, F.expr("id <=> c_id AND version = was"), "left")
    none = F.lit(0)
    return out.select(
        "id", "n_chars", "n_pretokens", "n_tokens", F.coalesce("n_edits", none).alias("n_edits"),
        F.coalesce("n_reencoded", none.cast("long")).alias("n_reencoded"), F.coalesce("after", "n_tokens").alias("n_tokens_after"),
    )
