"""Mixing sources to target weights by systematic sampling (built-in functions only).

Each source gets a word target by weighted sharing with a ceiling. All documents of a source have
the same expected number of copies (target / source size), so the prefix sum of expected copies is
that rate times the document's rank; one random offset per source is added, and a document is
emitted once for each integer boundary its step crosses.

The rank is built in two levels, so that no task holds a whole source: a document falls into a cell
(source, size class, salt), cells are counted and prefix-summed per source (a few thousand cells at
most each), and rows are numbered within their cell. Ranking by size class first makes the copies
an even spread over short and long documents, which brings words taken close to the target.

Defined results: null text has size 0; a null source is a source of its own, ordered last; sources
without words have target 0 and rate 0; an empty table gives an empty table; repeated rows count
each on its own; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 64  # parts of a (source, size class), up to 2**33 rows; more rows have more parts


def salts_for(rows: int) -> int:
    return min(1 << 16, SALTS << (rows >> 33).bit_length())


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def source_key(source: Column) -> Column:
    """Sorts as the sources do by code point, with null after all others."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def size_class(size: Column) -> Column:
    """Eight classes for every power of two, from integer arithmetic only."""
    bits = F.length(F.bin(size))
    fine = F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).bitwiseAND(F.lit(7))
    return F.when(size < 16, size.cast("int")).otherwise((bits * 8 + fine).cast("int"))


def unit_hash(value: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """sizes(src, size) -> src, source_size, target: weights go round the sources in order; what a
    source's ceiling leaves over is shared again by weight.

    The table of sources (one row each, aggregated map-side first) is ranked in one place.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy("src")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1)
    )
    per = per.withColumn("w", weight).withColumn("cap", F.lit(float(ceiling)) * F.col("source_size"))
    whole = Window.partitionBy()
    tight = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"total": F.sum("source_size").over(whole), "all_w": F.sum("w").over(whole)})
    left = F.lit(float(share)) * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumns({"level": level, "at": F.row_number().over(tight)})
    per = per.withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    final = F.min(F.when(F.col("free"), F.struct("at", "level"))).over(whole)
    per = per.withColumn("final", final)
    target = F.when(F.col("final").isNull() | (F.col("at") < F.col("final.at")), F.col("cap")).otherwise(F.col("final.level") * F.col("w"))
    return per.select("src", "source_size", target.alias("target"))


def systematic_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """One row per input row: ``id, size, source_size, target, copies, taken`` (taken = copies * size)."""
    ident = F.col(id_col)
    tag = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary"))
    docs = df.select(ident.alias("id"), source_key(F.col(source_col)).alias("src"), word_count(F.col(text_col)).alias("size"), tag.alias("tag"), text_hash(F.col(text_col)).alias("text_hash"))
    docs = materialize(docs, "mix-sizes")
    salt = F.pmod(F.conv(F.substring("tag", 1, 4), 16, 10).cast("int"), F.lit(salts_for(docs.count())))
    docs = docs.withColumns({"cls": size_class(F.col("size")), "salt": salt})
    targets = source_targets(docs.select("src", "size"), weights, share, ceiling)
    cell = ["src", "cls", "salt"]
    ahead = Window.partitionBy("src").orderBy("cls", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = docs.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(targets, "src")
    offset = unit_hash(F.concat(F.lit(f"{seed}/"), F.col("src")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    cells = cells.select(*cell, "ahead", "source_size", "target", rate.alias("rate"), offset.alias("offset"))
    within = Window.partitionBy(*cell).orderBy("size", "tag", "id", "text_hash")
    rows = docs.withColumn("nth", F.row_number().over(within)).join(cells, cell)
    rank = F.col("ahead") + F.col("nth")
    crossed = F.floor(rank * F.col("rate") + F.col("offset")) - F.floor((rank - 1) * F.col("rate") + F.col("offset"))
    rows = rows.withColumn("copies", crossed.cast("long"))
    return rows.select("id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "src", "text_hash")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixture itself: the rows of ``df``, each as often as it was drawn.

    Rows that share id, text and source (null ids included) stand for each other: what they were drawn
    in all is dealt evenly among them.
    """
    key = ["__fb_id", "__fb_text", "__fb_src"]
    drawn = systematic_copies(df, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    drawn = drawn.groupBy("id", "text_hash", "src").agg(F.sum("copies").alias("__fb_total"), F.count(F.lit(1)).alias("__fb_n")).where("__fb_total > 0")
    rows = df.withColumns({"__fb_id": F.col(id_col), "__fb_text": text_hash(F.col(text_col)), "__fb_src": source_key(F.col(source_col))})
    drawn = drawn.select(F.col("id").alias("__fb_i"), F.col("text_hash").alias("__fb_t"), F.col("src").alias("__fb_s"), "__fb_total", "__fb_n")
    joined = rows.join(drawn, F.expr("__fb_id <=> __fb_i AND __fb_text = __fb_t AND __fb_src = __fb_s"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    share = lambda at: F.floor(at * F.col("__fb_total") / F.col("__fb_n"))
    copies = joined.withColumn("__fb_nth", nth).withColumn("__fb_copies", (share(F.col("__fb_nth")) - share(F.col("__fb_nth") - 1)).cast("int"))
    each = copies.withColumn("__fb_each", F.explode(F.array_repeat(F.lit(0), F.col("__fb_copies"))))
    return each.select(*[F.col(f"`{c}`") for c in df.columns])
