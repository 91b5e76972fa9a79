"""Findings of all checkers: union, order, overlap, counts, verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DETECTORS

PLACE = ("start_line", "start_col", "end_line", "end_col")


def union(*found: DataFrame) -> DataFrame:
    """All findings, equal ones once."""
    return reduce(DataFrame.unionByName, found).dropDuplicates()


def detector_rank(detector: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, DETECTORS)), detector)


def in_order(origin: str = "origin_id") -> list[Column]:
    """By origin and place; at one place in the order of detectors, then by replacements."""
    return [F.col(origin), *map(F.col, PLACE), detector_rank(F.col("detector")), F.col("replacements")]


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether findings of one origin overlap: their lines meet and, by who starts first, their columns.

    Findings that only share a boundary column do not; columns of spans on several lines are compared as they are.
    """
    apart = (a["end_line"] < b["start_line"]) | (b["end_line"] < a["start_line"])
    first = (a["start_line"] < b["start_line"]) | ((a["start_line"] == b["start_line"]) & (a["start_col"] < b["start_col"]))
    return ~apart & F.when(first, a["end_col"] > b["start_col"]).otherwise(a["start_col"] < b["end_col"])


def without_overlaps(found: DataFrame, origin: str = "origin_id") -> DataFrame:
    """Findings that do not overlap the one just before them, whether that one is kept or not."""
    w = Window.partitionBy(origin).orderBy(*in_order(origin)[1:])
    rows = found.withColumn("__before", F.lag(F.struct(*PLACE)).over(w))
    hit = overlaps({c: F.col(c) for c in PLACE}, {c: F.col(f"__before.{c}") for c in PLACE})
    return rows.filter(F.col("__before").isNull() | ~hit).drop("__before")


def counts(found: DataFrame, origin: str = "origin_id") -> DataFrame:
    return found.groupBy(origin).agg(F.count("*").alias("n_findings"))


def verdict(found: DataFrame, exit_code: int = 1) -> DataFrame:
    """One row: the number of findings, whether there are any, and the exit code that follows."""
    n = F.count("*")
    return found.agg(n.alias("n_findings"), (n > 0).alias("mistakes"), F.when(n > 0, exit_code).otherwise(0).cast("int").alias("exit_code"))
