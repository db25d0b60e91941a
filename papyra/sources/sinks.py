"""Sinks (SNK-10..22): graphs, results and tables in the formats of the reference. All are distributed writes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.graph import admitted


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object for each row, as ``value``."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def graph_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-11: (kind, value): nodes and edges as JSON objects; a line format, so that no single row holds the graph."""
    return json_rows(nodes).select(F.lit("node").alias("kind"), "value").unionByName(json_rows(edges).select(F.lit("edge").alias("kind"), "value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def escape_xml(c: Column) -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def graphml_lines(nodes: DataFrame, edges: DataFrame, node_id: str = "id", attributes: Sequence[str] = (), ends: tuple[str, str] = ("source", "target")) -> DataFrame:
    """SNK-12: (part, value): lines of a GraphML file in order of part; lines of one part may stand in any order."""
    spark = nodes.sparkSession
    head = [(0, '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(f'<key id="{a}" for="node" attr.name="{a}" attr.type="string"/>\n' for a in attributes) + '<graph edgedefault="directed">')]
    data = [F.concat(F.lit(f'<data key="{a}">'), escape_xml(F.col(a).cast("string")), F.lit("</data>")) for a in attributes]
    node = F.concat(F.lit('<node id="'), escape_xml(F.col(node_id).cast("string")), F.lit('">'), F.concat_ws("", *data) if data else F.lit(""), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), escape_xml(F.col(ends[0]).cast("string")), F.lit('" target="'), escape_xml(F.col(ends[1]).cast("string")), F.lit('"/>'))
    schema = "part int, value string"
    rows = spark.createDataFrame(head, schema).unionByName(nodes.select(F.lit(1).alias("part"), node.alias("value"))).unionByName(edges.select(F.lit(2).alias("part"), edge.alias("value")))
    return rows.unionByName(spark.createDataFrame([(3, "</graph>\n</graphml>")], schema))


def write_graphml(lines: DataFrame, path: str) -> None:
    """Files in order of part; a reader that wants one file concatenates them by name."""
    lines.repartitionByRange(4, "part").sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)


def neo4j_nodes(nodes: DataFrame) -> DataFrame:
    """SNK-15: header names of the bulk import."""
    return nodes.select(F.col("id").alias("paperId:ID"), "title", F.array_join("authors", ";").alias("authors"), F.col("year").alias("year:int"), F.lit("Paper").alias(":LABEL"))


def neo4j_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias(":START_ID"), F.col("target").alias(":END_ID"), F.upper("relation").alias(":TYPE"), F.col("weight").alias("weight:float"))


def merge_batches(df: DataFrame, size: int = 1000) -> DataFrame:
    """SNK-14: rows in batches of at most ``size`` for a store that takes MERGE statements; a batch never crosses tasks."""
    parts = df.select(F.spark_partition_id().alias("part"), F.struct("*").alias("r"))
    return parts.withColumn("batch", F.floor((F.monotonically_increasing_id() % F.lit(1 << 33)) / size)).groupBy("part", "batch").agg(F.collect_list("r").alias("rows"))


def edge_list(edges: DataFrame, relation: str | None = None) -> DataFrame:
    """SNK-16."""
    return (edges.where(F.col("relation") == relation) if relation else edges).select("source", "target", "relation", "weight")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """SNK-17, GR-22."""
    inside = admitted(edges.withColumnsRenamed({"source": "src", "target": "dst"}), ids, key).withColumnsRenamed({"src": "source", "dst": "target"})
    return nodes.join(ids.select(key), key, "left_semi"), inside


def cytoscape(nodes: DataFrame, edges: DataFrame, label: str = "title") -> DataFrame:
    """SNK-18: elements as JSON; labels are cut at 50 characters."""
    short = F.when(F.length(label) > 50, F.concat(F.substring(label, 1, 50), F.lit("..."))).otherwise(F.col(label))
    n = nodes.select(F.lit("nodes").alias("group"), F.to_json(F.struct(F.struct(F.col("id").cast("string").alias("id"), short.alias("label")).alias("data"))).alias("value"))
    e = edges.select(F.lit("edges").alias("group"), F.to_json(F.struct(F.struct(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.col("relation").alias("label")).alias("data"))).alias("value"))
    return n.unionByName(e)


def save_index(spark: SparkSession, path: str, **tables: DataFrame) -> None:
    """SNK-20: each table of an index (postings, doc_stats, embeddings) under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """SRC-19."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def ddl(df: DataFrame, table: str) -> str:
    """SNK-22."""
    return f"CREATE TABLE {table} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema.fields)}) USING parquet"


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    """SNK-22: backup and restore."""
    spark.read.parquet(source).write.mode("overwrite").parquet(target)


def append_log(entries: DataFrame, path: str) -> None:
    """SNK-03: entries of one run are added; what is there is never rewritten."""
    entries.write.mode("append").parquet(path)


def export_stages(path: str, **stages: DataFrame) -> None:
    """SNK-21: each stage's rows as JSON lines under its name."""
    for name, df in stages.items():
        write_json(df, f"{path}/{name}")
