"""Line wrapping: words fill lines greedily up to a width, unbreakable pieces stay whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import comments
from . import cmark
from .batches import in_parts
from .chunks import Placed

WIDTH = 80
SKIPPED = ("SlashAsterisk", "SlashAsteriskEM", "SlashAsteriskAsterisk", "SlashStar")


def wrapped(text: Column, width: Column | int, indent: Column | int = 0) -> Column:
    """text re-wrapped, in JVM expressions: for texts without markup. A word beyond the width has a line of its own."""
    width, indent = (x if isinstance(x, Column) else F.lit(x) for x in (width, indent))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(a, w):
        fits = indent + F.char_length(a["line"]) + 1 + F.char_length(w) <= width
        more = F.struct(a["done"].alias("done"), F.concat(a["line"], F.lit(" "), w).alias("line"))
        new = F.struct(F.array_append(a["done"], a["line"]).alias("done"), w.alias("line"))
        return F.when(a["line"] == "", F.struct(a["done"].alias("done"), w.alias("line"))).when(fits, more).otherwise(new)

    return F.aggregate(words, start, add, lambda a: F.array_join(F.array_append(a["done"], a["line"]), "\n"))


def pieces(text: str, unbreakable: list[tuple[int, int]]) -> list[str]:
    """Words of a text; white space inside an unbreakable range does not part them."""
    whole = set()
    for s, e in unbreakable:
        whole.update(range(s, e))
    out, word = [], []
    for k, c in enumerate(text):
        if c.isspace() and k not in whole:
            if word:
                out.append("".join(word))
            word = []
        else:
            word.append(" " if c == "\n" else c)
    return [*out, "".join(word)] if word else out


def fill(words: list[str], width: int, indents: list[int] | None = None) -> list[str]:
    """Lines of at most width less their indentation: line n (from 1) uses indents[n + 1 - 1], the last one beyond their number."""
    indents = indents or [0]
    lines: list[str] = []
    line = ""
    for w in words:
        k = len(lines) + 1
        offset = indents[k] if k < len(indents) else indents[-1]
        if not line:
            line = w
        elif offset + len(line) + 1 + len(w) <= width:
            line += f" {w}"
        else:
            lines.append(line)
            line = w
    return [*lines, line] if line else lines


def reflow_text(text: str, width: int, prefix: str = "", suffix: str = "", indents: list[int] | None = None, delimiter: str = "\n", offsets=None) -> list[tuple[int, int, str]]:
    """(start, end, new text) of each paragraph that changes; lines after the first carry indentation, prefix and suffix.

    indents: blanks before the prefix, line by line, the last one for all that follow. offsets(start, end), if given,
    tells for a paragraph the columns at which its lines' text begins, from which both follow.
    """
    gap = " " if prefix and prefix[-1] in "/!" else ""
    out = []
    for s, e, unbreakable in cmark.paragraphs(text):
        words = pieces(text[s:e], [(a - s, b - s) for a, b in unbreakable])
        if offsets:
            columns = offsets(s, e)
            blanks = [max(0, n - len(prefix) - len(gap)) for n in columns]
        else:
            blanks = indents or [0]
            columns = [n + len(prefix) + (1 if prefix else 0) for n in blanks]
        lines = fill(words, width, columns)
        new = lines[0] if lines else ""
        for k, line in enumerate(lines[1:]):
            new += suffix + delimiter + " " * blanks[min(k, len(blanks) - 1)] + prefix + gap + line
        if lines != [x.strip() if k else x.rstrip() for k, x in enumerate(text[s:e].split("\n"))]:
            out.append((s, e, new))
    return out


def reflow(chunks: DataFrame, width: int = WIDTH, keys: tuple[str, ...] = ("origin_id", "chunk_idx"), text_col: str = "text") -> DataFrame:
    """keys, start, end, replacement for each paragraph of plain Markdown that wrapping changes."""
    own = chunks.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.fields) + ", start int, end int, replacement string"
    kinds = pa.schema([*to_arrow_schema(own), ("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_parts(batches, len(keys), lambda text: reflow_text(text or "", width), kinds)

    return chunks.select(*keys, text_col).mapInArrow(run, schema)


def reflow_chunks(chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Paragraphs of chunks (schema.CHUNKS and delimiter) that wrapping changes, as they stand in their origin.

    origin_id, chunk_idx, start, end (in the chunk's text), start_line, start_col, end_line, end_col, replacement: lines
    of a comment after its first carry their indentation and the comment's marks.
    """
    schema = "origin_id string, chunk_idx int, start int, end int, start_line int, start_col int, end_line int, end_col int, replacement string"
    kinds = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in schema.split(", ")])

    def of(text: str, v: dict, mapping: list[dict], delimiter: str | None) -> Iterator[tuple]:
        placed = Placed(text, mapping)
        blank = 1 if v["tag"] in ("TripleSlash", "DoubleSlashEM") else 0
        prefix, suffix = comments.marks(v["tag"], v["doc_prefix"], v["hashes"])
        for s, e, new in reflow_text(text, width, prefix, suffix, delimiter=delimiter or "\n", offsets=lambda s, e: placed.columns(s, e, blank)):
            yield s, e, *placed.place(s), *placed.place(e - 1), new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_parts(batches, 2, of, kinds)

    rows = chunks.filter(~F.col("variant.tag").isin(*SKIPPED) & (F.size("source_mapping") > 0))
    return rows.select("origin_id", F.col("chunk_idx").cast("int"), "text", "variant", "source_mapping", "delimiter").mapInArrow(run, schema)
