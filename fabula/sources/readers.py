"""Readers: JSON lines, JSON arrays, review sheets, graph XML, key-value lookups and SQL with arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: StructType | str, tag: str | None = None) -> DataFrame:
    """Well-formed lines; with ``tag``, those of that ``data_type`` or, for events, without one."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if tag is None:
        return rows
    kind = F.coalesce("data_type", F.lit("event")) if tag == "event" else F.col("data_type")
    return rows.where(kind == tag)


def first_lines(spark: SparkSession, path: str, schema: StructType | str, n: int) -> DataFrame:
    """The first n well-formed JSON lines, in order of files and lines."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("__f"), F.monotonically_increasing_id().alias("__i"), F.from_json("value", schema).alias("v"), F.try_parse_json("value").isNotNull().alias("__ok"))
    return lines.where("__ok").orderBy("__f", "__i").limit(n).select("v.*")


def default_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, key: str, source: str, target: str, limit: int = 1000) -> DataFrame:
    """Edges with both their nodes as structs ``n`` and ``m``, the first ``limit`` by ends."""
    node = lambda name: nodes.select(F.col(key).alias(f"__{name}"), F.struct(*nodes.columns).alias(name))
    rows = edges.join(node("n"), F.col(source) == F.col("__n")).join(node("m"), F.col(target) == F.col("__m"))
    return rows.orderBy(source, target).limit(limit).drop("__n", "__m")


def latest_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, modified, report..., latest): every JSON report under a folder, newest first; ``latest`` marks the newest."""
    from pyspark.sql import Window

    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    newest = F.max(F.struct("modified", "file")).over(Window.partitionBy())  # reports are few
    return rows.withColumn("latest", F.struct("modified", "file") == newest).orderBy(F.desc("modified"), F.desc("file"))


def text_array(spark: SparkSession, path: str) -> DataFrame:
    """(id, source_text, current_status) of a JSON array of strings: trimmed, blank ones skipped, first of equal ones kept; id is the MD5."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "t")).select("pos", F.trim("t").alias("source_text"))
    rows = items.where(F.length("source_text") > 0).groupBy("source_text").agg(F.min("pos").alias("pos"))
    return rows.select(F.md5(F.col("source_text").cast("binary")).alias("id"), "source_text", F.lit("pending_triage").alias("current_status"))


def review_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header; missing cells are empty strings."""
    return spark.read.option("header", True).csv(path).na.fill("")


def graph_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Nodes or edges of a GraphML file; attributes have the prefix ``_``."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def graph_elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of one tag from files that hold an element a line, as the GraphML sink writes them."""
    lines = spark.read.text(path).where(F.startswith("value", F.lit(f"<{tag} ")))
    return lines.select(F.from_xml("value", schema).alias("e")).select("e.*")


def lookup(df: DataFrame, keys: DataFrame, key: str, fields: Sequence[str] | None = None) -> DataFrame:
    """One row for each wanted key, with nulls where it is missing."""
    return keys.join(df.select(key, *(fields or [c for c in df.columns if c != key])), key, "left")


def missing_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return keys.join(df, key, "left_anti")


def sql(spark: SparkSession, text: str, views: Mapping[str, DataFrame], **arguments: Any) -> DataFrame:
    """SQL text with named arguments over the given views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=arguments)


def checked_lines(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """One row: lines, blank ones, broken ones, those that lack a required key, and good ones."""
    value = F.trim("value")
    parsed = F.try_parse_json(value).isNotNull() & F.startswith(value, F.lit("{"))
    lacks = F.lit(False)
    for key in required:
        lacks = lacks | F.get_json_object(value, f"$.{key}").isNull()
    blank = value == ""
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("blank"), F.count_if(~blank & ~parsed).alias("broken"), F.count_if(parsed & lacks).alias("lacking"), F.count_if(parsed & ~lacks).alias("good")
    )


def checked_sheet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One row: data lines of CSV files with a header, and those with another number of cells (quotes are minded)."""
    cells = F.size(F.split(F.regexp_replace("value", '"([^"]|"")*"', "x"), ","))
    lines = spark.read.text(path).where(F.col("value") != ",".join(columns))
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(cells != len(columns)).alias("ragged"))


def checked_graph(spark: SparkSession, path: str) -> DataFrame:
    """One row for GraphML or GEXF files of an element a line: nodes, repeated ids, edges, edges without one of their nodes."""
    lines = spark.read.text(path)
    ids = lines.where(F.startswith("value", F.lit("<node "))).select(F.regexp_extract("value", 'id="([^"]*)"', 1).alias("id"))
    edges = lines.where(F.startswith("value", F.lit("<edge "))).select(F.regexp_extract("value", 'source="([^"]*)"', 1).alias("s"), F.regexp_extract("value", 'target="([^"]*)"', 1).alias("t"))
    known = ids.distinct()
    loose = edges.join(known.select(F.col("id").alias("s"), F.lit(1).alias("a")), "s", "left").join(known.select(F.col("id").alias("t"), F.lit(1).alias("b")), "t", "left")
    nodes = ids.agg(F.count(F.lit(1)).alias("nodes"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("repeated"))
    return nodes.join(F.broadcast(loose.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("loose"))))  # one row each


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, modified) of the files under a folder, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def older_than(spark: SparkSession, path: str, before) -> int:
    """Deletes the files under a folder that were last written before a time; how many went."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs, limit, gone = root.getFileSystem(conf), int(before.timestamp() * 1000), 0
    for status in fs.listStatus(root):
        if status.isFile() and status.getModificationTime() < limit:
            fs.delete(status.getPath(), False)
            gone += 1
    return gone


def spreadsheet_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(file, row, value) of one named column over every .xlsx file under a path: the first sheet's cells, by the header
    row; files without that column give nothing. A file is read whole in one task."""
    from collections.abc import Iterator

    import pyarrow as pa

    def cells(body: bytes) -> list[tuple[int, str]]:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
            sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
            rows = ElementTree.fromstring(z.read(sheet)).iter(f"{space}row")
            wanted, out = None, []
            for at, row in enumerate(rows):
                for cell in row.iter(f"{space}c"):
                    letters = re.match("[A-Z]*", cell.get("r", "")).group()
                    value = cell.find(f"{space}v")
                    inline = "".join(t.text or "" for t in cell.iter(f"{space}t"))
                    text = shared[int(value.text)] if cell.get("t") == "s" else inline or (value.text if value is not None else "")
                    if at == 0 and text == column:
                        wanted = letters
                    elif at and letters == wanted and text:
                        out.append((at, text))
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(name, at, text) for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for at, text in cells(body)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["file", "row", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content").mapInArrow(run, "file string, row int, value string")
