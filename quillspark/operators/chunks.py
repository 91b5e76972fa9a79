"""Neighbouring literals become chunks: islands of one category on consecutive lines, joined by newlines."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema


def islands(literals: DataFrame, origin: str = "origin_id", category: str = "category", start: str = "start_line", end: str = "end_line", apart: str | None = None) -> DataFrame:
    """Adds chunk_idx (from 0, in order of lines): a literal joins the one before if it has its category and ends on the line after its end.

    apart: a boolean column that makes a literal start a chunk whatever is before it.
    """
    w = Window.partitionBy(origin).orderBy(start, end)
    joins = (F.col(category) == F.lag(category).over(w)) & (F.col(end) == F.lag(end).over(w) + 1)
    if apart:
        joins &= ~F.col(apart)
    rows = literals.withColumn("__new", F.when(joins, 0).otherwise(1))
    return rows.withColumn("chunk_idx", (F.sum("__new").over(w) - 1).cast("int")).drop("__new")


def render(literals: DataFrame, origin: str = "origin_id", order: str = "start_line", text: str = "text") -> DataFrame:
    """A row for each chunk: the texts joined by newlines and the range of each within the chunk."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("text"), *[F.col(c).alias(c) for c in ("span", "variant", "category") if c in literals.columns])))
    rows = literals.groupBy(origin, "chunk_idx").agg(parts.alias("parts"))
    rows = rows.withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), "\n"))
    # offsets as a running sum over the lengths before
    ends = F.aggregate("parts", F.array().cast("array<int>"), lambda a, p: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1) + 1, F.lit(0)) + F.char_length(p["text"])))
    rows = rows.withColumn("ends", ends)
    return rows.withColumn("ranges", F.zip_with("parts", "ends", lambda p, e: F.struct((e - F.char_length(p["text"])).cast("int").alias("start"), e.alias("end")))).drop("ends")


def chunks(literals: DataFrame) -> DataFrame:
    """Literals (schema.LITERALS) to chunks (schema.CHUNKS); sources that do not lex have none."""
    rows = literals.filter("category <> 'Error'").withColumn("start_line", F.col("span.start.line")).withColumn("end_line", F.col("span.end.line"))
    rows = rows.withColumn("apart", (F.col("category") == "Dev") & (F.col("rendered").startswith("/*")) & (F.col("lit_idx") >= 0) & F.col("first_of_block"))
    out = render(islands(rows, apart="apart"))
    first = F.get("parts", F.lit(0))
    mapping = F.arrays_zip(F.col("ranges").alias("range"), F.transform("parts", lambda p: p["span"]).alias("span"))
    return out.select("origin_id", "chunk_idx", first["category"].alias("category"), first["variant"].alias("variant"), "text", F.transform(mapping, lambda m: F.struct(m["range"].alias("range"), m["span"].alias("span"))).alias("source_mapping"))


def markdown_chunks(origins: DataFrame) -> DataFrame:
    """A chunk for each Markdown origin, the whole text; texts without a line give none."""
    lines = F.split(F.regexp_replace("content", "\n$", ""), "\n")
    last = F.element_at(lines, -1)
    end = F.struct(F.size(lines).alias("line"), F.greatest(F.char_length(last) - 1, F.lit(0)).alias("col"))
    mapping = F.array(F.struct(F.struct(F.lit(0).alias("start"), F.char_length("content").alias("end")).alias("range"), F.struct(F.struct(F.lit(1).alias("line"), F.lit(0).alias("col")).alias("start"), end.alias("end")).alias("span")))
    variant = F.struct(F.lit("CommonMark").alias("tag"), F.lit(None).cast("string").alias("doc_prefix"), F.lit(0).alias("hashes"))
    return origins.filter("content <> ''").select("origin_id", F.lit(0).alias("chunk_idx"), F.lit("CommonMark").alias("category"), variant.alias("variant"), F.col("content").alias("text"), mapping.alias("source_mapping"))


def fragments(chunk_rows: DataFrame) -> DataFrame:
    """origin_id, chunk_idx and each fragment's f_start, f_end, line, col."""
    rows = chunk_rows.select("origin_id", "chunk_idx", F.explode("source_mapping").alias("m"))
    return rows.select("origin_id", "chunk_idx", F.col("m.range.start").alias("f_start"), F.col("m.range.end").alias("f_end"), F.col("m.span.start.line").alias("line"), F.col("m.span.start.col").alias("col"))


class Placed:
    """A chunk's text with the fragments that map it to its origin."""

    def __init__(self, text: str, mapping: list[dict]):
        self.text, self.fragments = text, sorted((m["range"]["start"], m["range"]["end"], m["span"]["start"]["line"], m["span"]["start"]["col"]) for m in mapping)
        self.starts, self.newlines = [f[0] for f in self.fragments], [m.start() for m in re.finditer("\n", text)]

    def place(self, at: int) -> tuple[int, int]:
        """Line and column of a place in the text."""
        start, _, line, col = self.fragments[max(0, bisect_right(self.starts, at) - 1)]
        n, first = bisect_left(self.newlines, at), bisect_left(self.newlines, start)
        return (line + n - first, at - self.newlines[n - 1] - 1) if n > first else (line, col + at - start)

    def columns(self, start: int, end: int, blank: int) -> list[int]:
        """For each line of a range, the column at which its fragment's text begins; blank: columns that Markdown takes off all but the first."""
        out: list[int] = []
        for a, b, _, _ in self.fragments[max(0, bisect_right(self.starts, start) - 1) : bisect_left(self.starts, end)]:
            s, e = max(a, start), min(b, end)
            if s < e:
                own = self.place(s)[1]
                out += [max(own, blank) if not out else own + blank] * (self.text.count("\n", s, e) + 1)
        return out or [0]


__all__ = ["islands", "render", "chunks", "markdown_chunks", "fragments", "Placed", "schema"]
