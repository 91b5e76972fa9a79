"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, release, shared_dir, shared_path

__all__ = ["SPACES", "UPPER", "LOWER", "ascii_lower", "cut", "documents", "let", "release", "shared_dir", "shared_path"]

#: ASCII white space, as the operators define it (space and U+0009 to U+000D).
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, other letters as they are; lower() does the same to text of ASCII alone, and faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
