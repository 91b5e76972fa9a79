"""Positions in text: lines, ranges, spans and the ways between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sub_chars(text: Column, start: Column, end: Column) -> Column:
    """Code points start to end; empty where the range is empty or begins outside."""
    inside = (start >= 0) & (start < end) & (start < F.char_length(text))
    return F.when(inside, F.substring(text, start + 1, end - start)).otherwise("")


def _code_points(text: Column, n_bytes: Column) -> Column:
    """How many code points begin in the first n_bytes of a text: bytes that are no continuation of one."""
    firsts = F.regexp_replace(F.hex(F.substring(text.cast("binary"), F.lit(1), n_bytes)), "(.).", "$1")
    return F.char_length(F.translate(firsts, "89AB", ""))


def byte_range_to_chars(text: Column, start: Column, end: Column) -> Column:
    """A range of bytes as one of code points: those it cuts are inside; null where it begins outside, an end beyond is the text's."""
    n = F.octet_length(text)
    return F.when((start >= 0) & (start < n), F.struct((_code_points(text, start + 1) - 1).alias("start"), _code_points(text, F.least(end, n)).alias("end")))


def shifted(r: Column, n: Column) -> Column:
    """A range n code points on; it does not go below 0."""
    move = lambda x: F.greatest(x + n, F.lit(0)).cast("int")
    return F.struct(move(r["start"]).alias("start"), move(r["end"]).alias("end"))


def place_of(text: Column, offset: Column) -> Column:
    """Line and column of an offset in a text; null outside."""
    before = F.substring(text, F.lit(1), offset)
    line = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.when((offset >= 0) & (offset < F.char_length(text)), pos(line, F.char_length(F.substring_index(before, "\n", -1))))


def pos(line: Column, col: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), col.cast("int").alias("col"))


def span(l0: Column, c0: Column, l1: Column, c1: Column) -> Column:
    return F.struct(pos(l0, c0).alias("start"), pos(l1, c1).alias("end"))


def is_multiline(s: Column) -> Column:
    return s["start"]["line"] != s["end"]["line"]


def one_line_len(s: Column) -> Column:
    """Length of a span on one line; null on several."""
    return F.when(~is_multiline(s), s["end"]["col"] + 1 - s["start"]["col"])


def covers_line(s: Column, line: Column) -> Column:
    return line.between(s["start"]["line"], s["end"]["line"])


def span_to_range(s: Column) -> Column:
    """The columns of a span as a range; null on several lines."""
    return F.when(~is_multiline(s), F.struct(s["start"]["col"].alias("start"), (s["end"]["col"] + 1).alias("end")))


def range_to_span(line: Column, start: Column, end: Column) -> Column:
    """The span of columns start to end of a line; null for an empty range."""
    return F.when(start < end, span(line, start, line, end - 1))


def relative_to(inner: Column, outer: Column) -> Column:
    """The range of one span in another that starts on its line; null where it is not inside."""
    same = (inner["start"]["line"] == outer["start"]["line"]) & (inner["end"]["line"] == inner["start"]["line"])
    inside = same & (inner["start"]["col"] >= outer["start"]["col"]) & ((inner["end"]["line"] < outer["end"]["line"]) | (inner["end"]["col"] <= outer["end"]["col"]))
    return F.when(inside, F.struct((inner["start"]["col"] - outer["start"]["col"]).alias("start"), (inner["end"]["col"] + 1 - outer["start"]["col"]).alias("end")))


def dominant_delimiter(text: Column) -> Column:
    """The line ending a text uses most; of equally many, the one seen first; null without any.

    Halves of two-character endings do not count on their own.
    """
    times = lambda d: ((F.char_length(text) - F.char_length(F.replace(text, F.lit(d), F.lit("")))) / len(d)).cast("int")
    pairs = F.greatest(times("\r\n"), times("\n\r"))
    counts = {"\r": times("\r") - pairs, "\n": times("\n") - pairs, "\r\n": times("\r\n"), "\n\r": times("\n\r")}
    seen = F.array(*[F.struct(n.alias("n"), (-F.instr(text, d)).alias("at"), F.lit(len(d)).alias("size"), F.lit(d).alias("d")) for d, n in counts.items()])
    best = F.array_max(F.filter(seen, lambda x: x["n"] > 0))
    return best["d"]


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def running_sums(xs: Column, block: int = 64) -> Column:
    """For each element of an array of numbers, the sum of those before it, within the row: no window, so no shuffle.

    Appending to an array copies it, so sums run within blocks, and over the sums of blocks.
    """
    nothing = F.array().cast("array<int>")

    def run(ys: Column, start: Column) -> Column:
        grown = F.aggregate(ys, F.array_append(nothing, start.cast("int")), lambda a, y: F.array_append(a, (F.element_at(a, -1) + y).cast("int")))
        return F.slice(grown, F.lit(1), F.size(ys))

    total = lambda ys: F.aggregate(ys, F.lit(0), lambda a, y: (a + y).cast("int"))
    blocks = lambda ys: F.transform(F.sequence(F.lit(0), F.floor((F.size(ys) - 1) / block).cast("int")), lambda k: F.slice(ys, k * block + 1, F.lit(block)))
    starts = lambda bs: let(F.transform(bs, total), lambda ts: run(ts, F.lit(0)))
    sums = lambda bs: F.flatten(F.zip_with(bs, starts(bs), run))
    return let(xs, lambda ys: F.when(F.size(ys) == 0, nothing).otherwise(let(blocks(ys), sums)))


def explode_rows(df: DataFrame, keep: list[str], array: Column, at: str) -> DataFrame:
    """keep, at (the position) and x for each element of array.

    An outer explode whose empty rows go afterwards: for an inner one Spark would first filter by the size of the array,
    and compute it once more for that.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, "x")).filter(F.col(at).isNotNull())


def _lines(text: Column, ends_empty: bool) -> Column:
    """line and start_off of each line of a text as array<struct>; ends_empty: with the empty line after a last newline."""
    split = F.split(text, "\n")
    if not ends_empty:
        split = let(split, lambda ls: F.when(F.element_at(ls, -1) == "", F.slice(ls, F.lit(1), F.size(ls) - 1)).otherwise(ls))
    return let(split, lambda ls: F.zip_with(ls, running_sums(F.transform(ls, lambda x: F.char_length(x) + 1)), lambda x, at: F.struct(x.alias("line"), at.alias("start_off"))))


def _line_rows(df: DataFrame, id_col: str, text_col: str, ends_empty: bool) -> DataFrame:
    rows = explode_rows(df, [id_col], _lines(F.col(text_col), ends_empty), "ln")
    return rows.select(id_col, (F.col("ln") + 1).alias("line_no"), F.col("x.start_off").alias("start_off"), F.col("x.line").alias("line"))


def line_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, line_no, start_off, line: a row for each line, with the offset at which it starts."""
    return _line_rows(df, id_col, text_col, True)


def text_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """line_table without the empty line that a newline at the end would leave."""
    return _line_rows(df, id_col, text_col, False)


def covered_lines(lines: DataFrame, start: Column, end: Column) -> DataFrame:
    """Of text_lines, those that a range touches, with l_start and l_end (no newline included)."""
    l_end = F.col("start_off") + F.char_length("line")
    touched = (l_end >= start) & ((F.col("start_off") < end) | (F.col("line_no") == 1))
    return lines.filter(touched).withColumn("l_start", F.col("start_off")).withColumn("l_end", l_end)


def find_spans(fragments: DataFrame, start: Column, end: Column) -> DataFrame:
    """Clips single-line fragments (f_start, f_end, line, col) to a range and places them: s, e, line, c0, c1; empty ones go."""
    s, e = F.greatest("f_start", start), F.least("f_end", end)
    clipped = fragments.withColumn("s", s).withColumn("e", e).filter("s < e")
    c0 = F.col("col") + F.col("s") - F.col("f_start")
    return clipped.withColumn("c0", c0).withColumn("c1", F.col("c0") + F.col("e") - F.col("s") - 1)


def find_covered_spans(fragments: DataFrame, start: Column, end: Column) -> DataFrame:
    """The fragments (f_start, f_end) that a range touches, whole; one that begins where the range ends counts, an empty one does not."""
    return fragments.filter((F.col("f_end") > start) & (F.col("f_start") <= end) & (F.col("f_start") < F.col("f_end")))


def to_content_range(fragments: DataFrame, line: Column, c0: Column, c1: Column) -> DataFrame:
    """The range of a span on one line through the fragment that covers the line: s, e; without one, no row."""
    inside = fragments.filter((F.col("line") == line) & (c0 >= F.col("col")) & (c1 < F.col("col") + F.col("f_end") - F.col("f_start")))
    return inside.withColumn("s", F.col("f_start") + c0 - F.col("col")).withColumn("e", F.col("f_start") + c1 + 1 - F.col("col"))
