"""Origins as rows: from tables, from files that Spark reads, from manifests."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut
from .project import Found


def from_rows(df: DataFrame, id_col: str, text_col: str, kind: str = "cmark") -> DataFrame:
    """A table's rows as origins, none lost: rows of one id and one text are one origin.

    Where an id has several texts, or is null, the text's digest follows the id after a #, so that each has an id of its
    own. Which ids are there several times comes from ids and hashes alone; texts are joined to that, usually small, table.
    """
    content = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("string").alias("origin_id"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("path"), content.alias("content"))
    ids = rows.select("origin_id", F.xxhash64("content").alias("h")).groupBy("origin_id").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    several = (F.col("lo") != F.col("hi")) | F.col("origin_id").isNull()
    many = cut(ids.filter((F.col("n") > 1) | F.col("origin_id").isNull()).select(F.col("origin_id").alias("__id"), several.alias("__several")), "repeated-ids")
    rows = rows.join(many, F.col("origin_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    own = F.when(F.col("__several"), F.concat(F.coalesce("origin_id", F.lit("")), F.lit("#"), F.md5("content"))).otherwise(F.col("origin_id"))
    again = rows.filter("__several is not null").withColumn("origin_id", own).dropDuplicates(["origin_id"])
    return rows.filter("__several is null").union(again).drop("__several")


def kind_of_path(path: Column) -> Column:
    return F.when(path.rlike(r"(^|/)Cargo\.toml$"), "manifest").when(path.rlike(r"\.md$"), "cmark").when(path.rlike(r"\.rs$"), "rust")


def from_files(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """Whole files as origins, each once, read by Spark; others than Rust, Markdown and manifests are left out. Spark plans no split for an empty file, so those have no row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(paths).select("path", F.col("content").cast("string").alias("content"))
    rows = rows.withColumn("kind", kind_of_path(F.col("path"))).filter("kind is not null")
    return rows.select(F.col("path").alias("origin_id"), "kind", "path", "content").dropDuplicates(["origin_id"])


def from_project(spark: SparkSession, found: Found) -> DataFrame:
    """The files that project.extract found, and descriptions with their text."""
    schema = "origin_id string, kind string, path string, content string"
    named = [("rust", p) for p in found.rust] + [("cmark", p) for p in found.markdown]
    files = [p for _, p in named if os.path.getsize(p)]
    rows = from_files(spark, files) if files else spark.createDataFrame([], schema)
    if blank := [(p, k, p, "") for k, p in named if not os.path.getsize(p)]:
        rows = rows.unionByName(spark.createDataFrame(blank, schema))
    if found.descriptions:
        told = spark.createDataFrame([(f"{p}#description", "description", p, d) for p, d in found.descriptions], rows.schema)
        rows = rows.unionByName(told)
    return rows


def description_span(manifest: str) -> tuple[str, tuple[int, int, int, int]] | None:
    """The description in a manifest's text and its place (line, col, line, col), without the quotes around it."""
    value = tomllib.loads(manifest).get("package", {}).get("description")
    if not value:
        return None
    at = manifest.find(value)
    if at < 0:
        return None
    before, inside = manifest[:at], manifest[: at + len(value) - 1]
    place = lambda s: (s.count("\n") + 1, len(s) - s.rfind("\n") - 1)
    return value, (*place(before), *place(inside))


def load_span(text: Column, l0: Column, c0: Column, l1: Column, c1: Column) -> Column:
    """The text of a span, from its first to its last position."""
    lines = F.split(text, "\n")
    off = lambda line, col: F.aggregate(F.slice(lines, F.lit(1), line - 1), F.lit(0), lambda a, s: a + F.char_length(s) + 1) + col
    return F.substring(text, off(l0, c0) + 1, off(l1, c1) - off(l0, c0) + 1)
