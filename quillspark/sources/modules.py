"""Module trees of many projects at once: files as rows, declarations as edges, closures by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rustlex
from ..tables import cut, pieces, shared_path

#: Bytes of files, by Spark's estimate, that one task of a join on paths takes.
_FILES = 16 << 20


def _declarations(files: DataFrame) -> DataFrame:
    """parent, name, error: the modules that each file declares without a body, or what is wrong with a source that does not lex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, name, None) for name in dict.fromkeys(rustlex.modules(content or ""))]
                except ValueError as e:
                    rows.append((path, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in range(3)], names=["parent", "name", "error"])

    return files.select("path", "content").mapInArrow(run, "parent string, name string, error string")


def declared(files: DataFrame) -> DataFrame:
    """parent, name: the modules that each file (path, content) declares without a body."""
    return _declarations(files).filter("error is null").select("parent", "name")


def unreadable(files: DataFrame) -> DataFrame:
    """path, error: the files that do not lex, which is an error of the project."""
    return _declarations(files).filter("error is not null").select(F.col("parent").alias("path"), "error")


def _places(declarations: DataFrame, files: DataFrame) -> DataFrame:
    """parent, name, n, child: at how many places a module's file is, and the first of them."""
    folder = F.regexp_extract("parent", "^(.*/)?[^/]*$", 1)
    stem = F.regexp_extract("parent", r"([^/]*?)(\.[^./]*)?$", 1)
    spots = F.array(F.concat(folder, "name", F.lit("/mod.rs")), F.concat(folder, "name", F.lit(".rs")), F.concat(folder, stem, F.lit("/"), "name", F.lit(".rs")))
    rows = declarations.select("parent", "name", F.explode(F.array_distinct(spots)).alias("path"))
    n = pieces(files, _FILES)
    met = rows.repartition(n, "path").join(files.select("path").repartition(n, "path").distinct(), "path")
    return met.repartition(n, "parent", "name").groupBy("parent", "name").agg(F.count("*").alias("n"), F.min("path").alias("child"))


def resolved(declarations: DataFrame, files: DataFrame) -> DataFrame:
    """parent, name, child: each declared module with the one file that it is in; modules without a file are left out."""
    return _places(declarations, files).filter("n = 1").select("parent", "name", "child")


def ambiguous(declarations: DataFrame, files: DataFrame) -> DataFrame:
    """parent, name, n: declared modules that are at several places, which is an error of the project."""
    return _places(declarations, files).filter("n > 1").select("parent", "name", "n")


def closure(roots: DataFrame, edges: DataFrame, depth: int = 1 << 30) -> DataFrame:
    """path, depth: roots (path) and all files that modules lead to, each once with its smallest depth, down to a depth.

    Breadth first: each round joins the newest files with the edges and takes what is not there yet; the number of
    rounds is the depth of the deepest tree, whatever the number of files. Each depth is a table of one folder, so a
    round's plan is as small as the first one's, and nothing of it is sent to the driver: joins sort, none broadcasts.
    """
    spark = edges.sparkSession
    folder = shared_path(spark, "closure")
    edges = cut(edges.select("parent", "child").distinct(), "edges")

    def table(*levels: int) -> DataFrame:
        return spark.read.schema("path string, depth int").parquet(*[f"{folder}/{k}" for k in levels])

    def put(rows: DataFrame, level: int) -> DataFrame:
        rows.withColumn("depth", F.lit(level)).write.parquet(f"{folder}/{level}")
        return table(level)

    newest, level = put(roots.select("path").distinct(), 0), 0
    while level < depth and not newest.isEmpty():
        step = newest.select(F.col("path").alias("parent")).join(edges.hint("merge"), "parent").select(F.col("child").alias("path")).distinct()
        newest = put(step.join(table(*range(level + 1)).select("path").hint("merge"), "path", "left_anti"), level := level + 1)
    return table(*range(level + 1))
