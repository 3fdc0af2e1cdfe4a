"""Graphs as files: one JSON document with five arrays, or a folder of Parquet tables; upserts by key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .schema import CLUSTERS, EDGES, EVIDENCE, NODE_CLUSTER, NODES, Graph

TABLES = {"nodes": NODES, "edges": EDGES, "evidence": EVIDENCE, "clusters": CLUSTERS, "node_cluster": NODE_CLUSTER}


def read_json(spark: SparkSession, path: str) -> Graph:
    """A document with the arrays nodes, edges, evidence, clusters, node_cluster."""
    whole = ", ".join(f"{name} array<struct<{_nested(schema)}>>" for name, schema in TABLES.items())
    doc = spark.read.option("multiLine", True).schema(whole).json(path)
    return Graph(**{name: doc.selectExpr(f"inline({name})") for name in TABLES})


def _nested(schema: str) -> str:
    depth, out, word = 0, [], ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += c
    return ",".join(f"{w.strip().split(' ', 1)[0]}:{w.strip().split(' ', 1)[1]}" for w in [*out, word])


def read_tables(spark: SparkSession, path: str) -> Graph:
    return Graph(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()})


def write_tables(graph: Graph, path: str) -> None:
    """Edges clustered by source, evidence by edge: the keys that queries join on."""
    keys = {"edges": "src", "evidence": "edge_id"}
    for f in fields(graph):
        table = getattr(graph, f.name)
        if key := keys.get(f.name):
            table = table.repartition(key).sortWithinPartitions(key)
        table.write.mode("overwrite").parquet(f"{path}/{f.name}")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table, read by ranges of a column; no cap on rows."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.options(**options).load()


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source, and those of target whose key source lacks."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def gold_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the parsed record, and the raw line where it can't be parsed."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return lines.select(F.col("_metadata.file_name").alias("file"), parsed.alias("record")).select("file", "record.*")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256, kind of every file of a tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin("json", "jsonl", "xml", "tsv", "html"), suffix).otherwise("other")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"))


def version(spark: SparkSession, folder: str) -> str:
    """A digest of the names, sizes and times of the files below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, seen = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame], key: str | None = None) -> DataFrame:
    """A table that many queries of an application read: built and written once, to the folder that all share, clustered by key.

    A name stands for one table while the application lives: it must name the input, its version included.
    """
    app = spark.sparkContext.applicationId
    if (app, name) not in _stored:
        rows = build()
        _stored[app, name] = scratch.write(rows.repartition(key).sortWithinPartitions(key) if key else rows, "graph")
    return spark.read.parquet(_stored[app, name])
