"""Writers: JSON lines, tagged JSON, CSV pairs, GraphML/GEXF text and review sheets. All write in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def tagged(events: DataFrame, relations: DataFrame) -> DataFrame:
    """Events and relations in one table, told apart by ``data_type``."""
    return events.withColumn("data_type", F.lit("event")).unionByName(relations.withColumn("data_type", F.lit("relation")), allowMissingColumns=True)


def csv_pair(nodes: DataFrame, edges: DataFrame, prefix: str) -> None:
    nodes.write.mode("overwrite").option("header", True).csv(f"{prefix}_nodes")
    edges.write.mode("overwrite").option("header", True).csv(f"{prefix}_edges")


def escape(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def graphml_elements(nodes: DataFrame, edges: DataFrame, node_id: str, source: str, target: str) -> DataFrame:
    """(value) one XML element for each node and edge; other columns become ``data`` elements."""

    def data(df: DataFrame, skip: set[str]) -> Column:
        parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), escape(F.col(c)), F.lit("</data>"))) for c in df.columns if c not in skip]
        return F.concat_ws("", *parts)

    n = nodes.select(F.concat(F.lit('<node id="'), escape(F.col(node_id)), F.lit('">'), data(nodes, {node_id}), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), escape(F.col(source)), F.lit('" target="'), escape(F.col(target)), F.lit('">'), data(edges, {source, target}), F.lit("</edge>")).alias("value"))
    return n.unionByName(e)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value): nodes and edges as JSON, a line each, so that no row holds the whole graph."""
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("value"))
    return line(nodes, "node").unionByName(line(edges, "edge"))


def review_sheet(state: DataFrame, key: str, text: str, confidence: str) -> DataFrame:
    """Rows for a reviewer, least sure first, with cells to fill in."""
    blank = F.lit(None).cast("string")
    rows = state.orderBy(confidence, key).select(key, text, confidence)
    return rows.withColumns({"human_decision": F.lit("unknown"), "human_event_type": blank, "human_notes": blank})


def _parts(nodes: DataFrame, edges: DataFrame, head: str, between: str, foot: str) -> DataFrame:
    """(part, value) lines of a document: concatenated in order of ``part`` they are one valid file."""
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([(0, head), (2, between), (4, foot)], "part int, value string")
    return fixed.unionByName(nodes.select(F.lit(1).alias("part"), "value")).unionByName(edges.select(F.lit(3).alias("part"), "value"))


_XML_TYPES = {"boolean": "boolean", "int": "integer", "bigint": "long", "float": "float", "double": "double"}


def gexf_lines(nodes: DataFrame, edges: DataFrame, node_id: str, label: str, source: str, target: str) -> DataFrame:
    """(part, value) of a GEXF 1.2 document: typed attributes of nodes and edges, labels ``Unknown`` where missing."""

    def attributes(df: DataFrame, cls: str, skip: set[str]) -> tuple[str, Column]:
        kept = [(c, t) for c, t in df.dtypes if c not in skip]
        defined = "".join(f'<attribute id="{cls[0]}_{c}" title="{c}" type="{_XML_TYPES.get(t, "string")}"/>' for c, t in kept)
        values = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<attvalue for="{cls[0]}_{c}" value="'), escape(F.col(c)), F.lit('"/>'))) for c, _ in kept]
        listed = F.concat(F.lit("<attvalues>"), F.concat_ws("", *values), F.lit("</attvalues>")) if kept else F.lit("")
        return f'<attributes class="{cls}">{defined}</attributes>' if kept else "", listed

    of_nodes, node_values = attributes(nodes, "node", {node_id, label})
    of_edges, edge_values = attributes(edges, "edge", {source, target})
    n = nodes.select(F.concat(F.lit('<node id="'), escape(F.col(node_id)), F.lit('" label="'), escape(F.coalesce(F.col(label).cast("string"), F.lit("Unknown"))), F.lit('">'), node_values, F.lit("</node>")).alias("value"))
    name = F.concat_ws("-", F.lit("e"), F.col(source).cast("string"), F.col(target).cast("string"))
    e = edges.select(F.concat(F.lit('<edge id="'), escape(name), F.lit('" source="'), escape(F.col(source)), F.lit('" target="'), escape(F.col(target)), F.lit('">'), edge_values, F.lit("</edge>")).alias("value"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph mode="static" defaultedgetype="directed">{of_nodes}{of_edges}<nodes>'
    return _parts(n, e, head, "</nodes><edges>", "</edges></graph></gexf>")


def graphml_lines(nodes: DataFrame, edges: DataFrame, node_id: str, source: str, target: str) -> DataFrame:
    """(part, value) of a GraphML document: header, typed keys, elements, end."""
    keys = "".join(
        f'<key id="{c}" for="{kind}" attr.name="{c}" attr.type="{_XML_TYPES.get(t, "string")}"/>' for kind, df, skip in (("node", nodes, {node_id}), ("edge", edges, {source, target})) for c, t in df.dtypes if c not in skip
    )
    elements = graphml_elements(nodes, edges, node_id, source, target)
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'
    return _parts(elements.where(F.startswith("value", F.lit("<node "))), elements.where(F.startswith("value", F.lit("<edge "))), head, "", "</graph></graphml>")


def document(lines: DataFrame, path: str) -> None:
    """Writes (part, value) lines in order over as many files as there are partitions; read in name order they are the document."""
    lines.repartitionByRange("part", "value").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def event_graph(events: DataFrame, key: str, subject: str, object_: str, participants: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of events: (name, kind) once each, the first kind by code point, and (event, name, edge) of the
    three kinds of edge; plain participants are persons."""
    one = lambda c, edge, kind: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("name"), F.lit(edge).alias("edge"), F.lit(kind).alias("kind")))
    people = F.transform(F.coalesce(participants, F.array().cast("array<string>")), lambda p: F.struct(p.alias("name"), F.lit("PARTICIPANT").alias("edge"), F.lit("PERSON").alias("kind")))
    ends = F.concat(F.array_compact(F.array(one(subject, "SUBJECT", "ENTITY"), one(object_, "OBJECT", "ENTITY"))), people)
    rows = events.select(F.col(key).alias("event"), F.explode(ends).alias("e")).select("event", "e.*").distinct()
    return rows.groupBy("name").agg(F.min("kind").alias("kind")), rows.select("event", "name", "edge").distinct()


def write_both(df: DataFrame, targets: dict, key: str) -> dict[str, int]:
    """Writes to several stores, each on its own: rows written by name, -1 for one that failed. Others are not held up."""
    done = {}
    for name, write in targets.items():
        try:
            write(df)
            done[name] = df.select(key).count()
        except Exception:  # a store that is down is told by its count; the caller decides
            done[name] = -1
    return done


def reset(spark, path: str, backup: str, schema: str) -> int:
    """Copies a table to a backup folder and leaves an empty table in its place; how many rows were kept aside."""
    rows = spark.read.schema(schema).parquet(path)
    rows.write.mode("overwrite").parquet(backup)
    kept = spark.read.schema(schema).parquet(backup).count()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return kept


def report(summary: DataFrame, samples: DataFrame, prefix: str) -> None:
    """A report as JSON beside a CSV of samples."""
    summary.write.mode("overwrite").json(f"{prefix}_report")
    samples.write.mode("overwrite").option("header", True).csv(f"{prefix}_samples")


def contexts(df: DataFrame, path: str) -> None:
    """Contexts with their nested hyperedges, a JSON object a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
