"""Where results go: blocks of text, tables, the files that origins came from."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks (origin_id, block and their place) as text in the order of origins and places, ranges of origins to a file."""
    rows = blocks.repartitionByRange("origin_id").sortWithinPartitions("origin_id", "start_line", "start_col", "end_line", "end_col")
    rows.select(F.concat("block", F.lit("\n")).alias("value")).write.text(path)


def write_texts(texts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Corrected texts as a table; Spark's commit makes all of them visible or none."""
    texts.write.mode(mode).parquet(path)


def local_path(origin_id: str) -> str:
    """The path of a file's origin, given as a path or a file: URI."""
    parsed = urlparse(origin_id)
    return unquote(parsed.path) if parsed.scheme == "file" else origin_id


def replace_file(path: str, content: str) -> None:
    """Writes a file beside the old one and puts it in its place at once; a reader sees the old text or the new one."""
    fd, new = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".quillspark-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(path):
            os.chmod(new, os.stat(path).st_mode & 0o7777)
        os.replace(new, path)
    except BaseException:
        os.unlink(new)
        raise


def rewrite(origins: DataFrame, texts: DataFrame) -> int:
    """Puts the texts that differ into the files of their origins, and returns how many.

    Tasks write the files, so workers must reach them by the same path; a repeated attempt writes the same text.
    """
    changed = origins.select("origin_id", F.col("content").alias("old")).join(texts, "origin_id").filter("old <> content").select("origin_id", "content")
    done = changed.sparkSession.sparkContext.accumulator(0)

    def put(rows: Iterator[Row]) -> None:
        for r in rows:
            replace_file(local_path(r.origin_id), r.content)
            done.add(1)

    changed.foreachPartition(put)
    return done.value
