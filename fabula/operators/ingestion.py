"""Documents, contexts and graphs into their tables, and calls to models that enter as a function on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as tx


def insert_documents(texts: DataFrame, documents: DataFrame, chunks: DataFrame, text: str, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(new documents(id, content), new chunks(id, doc, chunk_order, content)): ids are MD5s of trimmed contents, and only
    those that the tables lack come out, each once. Blank texts are left out."""
    rows = texts.select(F.trim(text).alias("content")).where("content <> ''").distinct()
    new = rows.select(F.concat(F.lit("doc-"), F.md5(F.col("content").cast("binary"))).alias("id"), "content").join(documents, "id", "left_anti")
    words = new.select(F.col("id").alias("doc"), tx.word_list(F.col("content")).alias("w"))
    pieces = words.select("doc", F.explode(tx.chunk_windows(F.col("w"), size, overlap)).alias("c")).select("doc", "c.chunk_order", "c.content")
    ids = pieces.withColumn("id", F.concat(F.lit("chunk-"), F.md5(F.col("content").cast("binary"))))
    first = ids.groupBy("id").agg(F.min(F.struct("doc", "chunk_order", "content")).alias("c")).join(chunks, "id", "left_anti")
    return new, first.select("id", "c.doc", "c.chunk_order", "c.content")


def insert_graph(entities: DataFrame, relations: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a given graph: names in upper case and quotes, sources looked up (``UNKNOWN`` else), and a
    placeholder node for every end that no entity names. entities(name, kind, source), relations(src, dst, weight, source),
    sources(source, chunk)."""
    named = lambda c: F.concat(F.lit('"'), F.upper(c), F.lit('"'))
    chunk = lambda df: df.join(sources.select(F.col("source").alias("__s"), "chunk"), F.col("source") == F.col("__s"), "left").withColumn("chunk", F.coalesce("chunk", F.lit("UNKNOWN")))
    nodes = chunk(entities).select(named(F.col("name")).alias("name"), F.coalesce("kind", F.lit("UNKNOWN")).alias("kind"), "chunk")
    nodes = nodes.groupBy("name").agg(F.min(F.struct("kind", "chunk")).alias("m")).select("name", "m.kind", "m.chunk")
    edges = chunk(relations).select(named(F.col("src")).alias("src"), named(F.col("dst")).alias("dst"), "weight", "chunk")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name"), "chunk").groupBy("name").agg(F.min("chunk").alias("chunk"))
    placeholders = ends.join(nodes, "name", "left_anti").select("name", F.lit("UNKNOWN").alias("kind"), "chunk")
    return nodes.unionByName(placeholders), edges


def contexts(events: DataFrame, key: str, kind: str, content: Column, roles: Column) -> DataFrame:
    """(id, content, metadata, hyperedge): an event as a retrievable context; ``roles`` is a map of arrays."""
    from fabula.functions import nested as ne

    nodes = ne.flat_distinct(roles)
    edge = F.struct(F.concat(F.lit("he_"), F.col(key).cast("string")).alias("id"), F.col(kind).alias("type"), nodes.alias("nodes"), F.size(nodes).alias("arity"))
    meta = F.struct(F.col(kind).alias("event_type"), F.size(F.map_keys(roles)).alias("roles"))
    return events.select(tx.context_id(tx.type_abbreviation(F.col(kind)), F.col(key).cast("string")).alias("id"), content.alias("content"), meta.alias("metadata"), edge.alias("hyperedge"))


def hypergraph(events: DataFrame, key: str, kind: str, fields: dict[str, str], order: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(kind, name, id), edges(edge, kind, node, role)) of events whose fields name entities of the given kinds; ids
    are ``kind_n`` as they first appear."""
    from .graph import create_or_get

    parts = F.array(*[F.struct(F.lit(f).alias("role"), F.lit(k).alias("node_kind"), F.trim(F.col(f).cast("string")).alias("name")) for f, k in fields.items()])
    rows = events.select(F.col(key).alias("edge"), F.col(kind).alias("kind"), F.col(order).alias("__o"), F.explode(parts).alias("p")).select("edge", "kind", "__o", "p.*").where("name <> ''")
    nodes = create_or_get(rows, "node_kind", "name", "__o")
    edges = rows.join(nodes, ["node_kind", "name"]).select("edge", "kind", F.col("id").alias("node"), "role").distinct()
    return nodes.select(F.col("node_kind").alias("kind"), "name", "id"), edges


def call(df: DataFrame, key: str, text: str, answer: Callable[[list[str]], list[str]], batch: int = 32, name: str = "answer") -> DataFrame:
    """(key, answer): an injected function from texts to answers, over Arrow batches, ``batch`` texts at a time. A batch
    that fails answers null, so that one bad text does not lose a task; nulls are asked as empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = [t or "" for t in b.column(1).to_pylist()], []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    out += answer(part)
                except Exception:  # a model's failure is data: the row stays, without an answer
                    out += [None] * len(part)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, name])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, {name} string")


def answered_rows(answers: DataFrame, key: str, answer: str, schema: str) -> DataFrame:
    """(id, key, fields...): one row for each object of the JSON array in an answer (a lone object counts as one)."""
    listed = F.when(F.startswith(F.trim(answer), F.lit("[")), F.col(answer)).otherwise(F.concat(F.lit("["), F.col(answer), F.lit("]")))
    rows = answers.select(key, F.posexplode(F.from_json(listed, f"array<struct<{schema}>>")).alias("place", "v")).where("v IS NOT NULL")
    ident = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("place").cast("string")).cast("binary"))
    return rows.select(ident.alias("id"), key, "v.*")


def model_for(key: Column, models: list[str]) -> Column:
    """Which of several models a row goes to: the same one each time, evenly dealt."""
    return F.element_at(F.array(*map(F.lit, models)), (F.pmod(F.xxhash64(key), F.lit(len(models))) + 1).cast("int"))


def stories(df: DataFrame, by: str, order: str, text: str, most: int = 20, cut: int = 100) -> DataFrame:
    """(story, n, summary): groups of at most ``most`` rows in order (larger ones in numbered batches); the summary joins
    the first three texts, each cut."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    rows = df.select(by, F.substring(text, 1, cut).alias("t"), at.alias("at")).withColumn("batch", F.floor(F.col("at") / most))
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    told = rows.groupBy(by, "batch").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("at") % most < 3, F.struct("at", "t")))).alias("parts"))
    name = F.when(F.col("size") > most, F.concat(F.col(by).cast("string"), F.lit("_batch"), (F.col("batch") + 1).cast("string"))).otherwise(F.col(by).cast("string"))
    return told.join(sizes, by).select(name.alias("story"), "n", F.array_join(F.transform("parts", lambda p: p["t"]), " | ").alias("summary"))


def two_level_summary(df: DataFrame, by: str, order: str, text: str, whole: int = 20, chunk: int = 15) -> DataFrame:
    """(by, n, chunks, summary): small groups summarised at once, larger ones by chunks whose summaries are joined. A
    summary is the first text of what it sums up."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    rows = df.select(by, text, at.alias("at")).join(df.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by)
    part = F.when(F.col("n") > whole, F.floor(F.col("at") / chunk)).otherwise(0)
    firsts = rows.groupBy(by, "n", part.alias("part")).agg(F.min(F.struct("at", text)).alias("f"))
    return firsts.groupBy(by, "n").agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.col(f"f.{text}").alias("t")))), lambda x: x["t"]), " / ").alias("summary"))


def complete_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """groups(group, key) as a model gave them -> (key, group): a row belongs to the first group that names it; one that
    none names is a group of its own (its key, negative)."""
    first = groups.groupBy(key).agg(F.min("group").alias("group"))
    return rows.select(key).join(first, key, "left").select(key, F.coalesce("group", -F.col(key) - 1).alias("group"))


def embed(df: DataFrame, key: str, text: str, vectors: Callable[[list[str]], list[list[float]]], size: int, batch: int = 32) -> DataFrame:
    """(key, vector): an injected embedding over Arrow batches; texts that are null or fail get zeros of that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    made = vectors([t or "" for t in part])
                except Exception:  # without a model there are zeros
                    made = [None] * len(part)
                out += [v if t and v is not None else [0.0] * size for t, v in zip(part, made)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "vector"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, vector array<double>")


def called_once(df: DataFrame, key: str, text: str, answer: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """(key, answer) where every distinct text is asked once, however many rows hold it."""
    from fabula.sources.scratch import materialize

    hashed = df.select(key, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("__h"), text)
    asked = hashed.groupBy("__h").agg(F.first(text).alias("__t"))
    told = materialize(call(asked, "__h", "__t", answer, batch), "answers")
    return hashed.select(key, "__h").join(told, "__h").drop("__h")


def learn_schema(df: DataFrame, by: str, json: str, share: float = 0.5) -> DataFrame:
    """(by, field, type, share, required): fields that enough of a group's JSON objects have, with their commonest type."""
    from fabula.functions.nested import value_type

    pairs = df.select(by, F.explode(F.from_json(json, "map<string,string>")).alias("field", "value"))
    n = df.where(F.from_json(json, "map<string,string>").isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    kinds = pairs.groupBy(by, "field", value_type(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("c"))
    best = kinds.groupBy(by, "field").agg(F.sum("c").alias("c"), F.min(F.struct((-F.col("c")).alias("x"), "type")).alias("m")).join(n, by)
    part = F.col("c") / F.col("n")
    return best.select(by, "field", F.col("m.type").alias("type"), part.alias("share"), (part >= 1).alias("required")).where(F.col("share") >= share)


def kept_entries(cache: DataFrame, age: str, used: str, ttl: float, most: int) -> DataFrame:
    """The entries of a cache that stay: not older than ``ttl`` seconds, and of these the most recently used."""
    return cache.where(F.col(age) <= ttl).orderBy(F.col(used).asc(), F.col("key")).limit(most)


def with_retries(work: Callable[[], DataFrame], times: int = 3, wait: float = 1.0) -> DataFrame:
    """Runs work again after a failure, waiting twice as long each time; the last failure is raised."""
    import time

    for at in range(times):
        try:
            return work()
        except Exception:
            if at + 1 == times:
                raise
            time.sleep(wait * 2**at)
    raise ValueError("times must be positive")


def extracted_graph(answers: DataFrame, key: str, answer: str) -> tuple[DataFrame, DataFrame]:
    """(entities(name, kind, descriptions, n), edges(relation, name, weight)) of delimited answers: an entity's kind is the
    commonest, its descriptions are a sorted set, edges of the same ends add up."""
    from fabula.functions.nested import delimited_records

    from .aggregates import mode_merge
    from .statistics import merge_edges

    records = delimited_records(answers, key, answer)
    entities = records.where("kind = 'entity'").select(F.upper(F.col("fields")[1]).alias("name"), F.get("fields", F.lit(2)).alias("type"), F.coalesce(F.get("fields", F.lit(3)), F.lit("")).alias("description"), F.col(key).cast("string").alias("source"), "relation")
    merged = mode_merge(entities, ["name"], "type", "description", "source")
    edges = merge_edges(entities.where("relation IS NOT NULL").withColumn("weight", F.lit(1)), "relation", "name", "weight", "source")
    return merged, edges
