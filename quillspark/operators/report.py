"""How findings are shown: replacements, excerpts, blocks of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.positions import let

SHOWN = 7


def replacements_text(r: Column) -> Column:
    """ - a, b, or c; beyond SHOWN the number of the others."""
    n = F.size(r)
    lead = F.array_join(F.slice(r, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    many = F.concat(F.lit(" - "), F.array_join(F.slice(r, 1, SHOWN), ", "), F.lit(", or one of "), (n - SHOWN).cast("string"), F.lit(" others"))
    two = F.concat(F.lit(" - "), F.get(r, F.lit(0)), F.lit(" or "), F.get(r, F.lit(1)))
    few = F.concat(F.lit(" - "), lead, F.lit(", or "), F.get(r, n - 1))
    return F.when(n == 0, "").when(n == 1, F.concat(F.lit(" - "), F.get(r, F.lit(0)))).when(n == 2, two).when(n <= SHOWN, few).otherwise(many)


def shorten(word: Column, most: int = 20) -> Column:
    """Long words as head4...tail4."""
    return F.when(F.char_length(word) > most, F.concat(F.left(word, F.lit(4)), F.lit("..."), F.right(word, F.lit(4)))).otherwise(word)


def excerpt(line: Column, start: Column, end: Column, width: int = 80, gutter: Column | None = None) -> tuple[Column, Column, Column]:
    """(text, offset and length of the marked part) of a line fitted to width, less what the gutter before it takes.

    A line that fits is shown as it is. Of others a long marked part is shortened and context is cut on both sides, with ..
    where it is; room is shared evenly, and what one side does not need goes to the other.
    """
    shown = _excerpt(line, start, end, F.lit(width) - (F.lit(0) if gutter is None else gutter))
    return shown["text"], shown["at"], shown["n"]


def _excerpt(line: Column, start: Column, end: Column, width: Column) -> Column:
    """excerpt() as struct(text, at, n). Each step is computed once: written out, an expression that names the one before
    several times is more code than the JVM takes for a method, and Spark would interpret all of it."""
    struct = lambda **x: F.struct(*[c.alias(k) for k, c in x.items()])
    at_most = lambda left, right, room, half: F.when(left + right <= room, left).when(left <= half, left).when(right <= half, room - right).otherwise(half)

    def room(x: Column) -> Column:
        own = struct(mark=x["mark"], n=F.char_length(x["mark"]), right=x["n"] - end, room=F.greatest(width - F.char_length(x["mark"]), F.lit(0)))
        return let(own, left)

    def left(x: Column) -> Column:
        return let(at_most(start, x["right"], x["room"], F.floor(x["room"] / 2).cast("int")), lambda take: right(x, take))

    def right(x: Column, take: Column) -> Column:
        r_take = F.least(F.when(start + x["right"] <= x["room"], x["right"]).otherwise(x["room"] - take), x["right"])
        return let(r_take, lambda r_take: texts(x, take, r_take))

    def texts(x: Column, l_take: Column, r_take: Column) -> Column:
        l_text, r_text = F.substring(line, start - l_take + 1, l_take), F.substring(line, end + 1, r_take)
        l_text = F.when(l_take < start, F.concat(F.lit(".."), F.substring(l_text, 3, 1 << 20))).otherwise(l_text)
        r_text = F.when(r_take < x["right"], F.concat(F.left(r_text, F.greatest(r_take - 2, F.lit(0))), F.lit(".."))).otherwise(r_text)
        return let(l_text, lambda l_text: struct(text=F.concat(l_text, x["mark"], r_text), at=F.char_length(l_text), n=x["n"]))

    cut = let(struct(n=F.char_length(line), mark=shorten(F.substring(line, start + 1, end - start))), room)
    return F.when(F.char_length(line) <= width, struct(text=line, at=start.cast("int"), n=(end - start).cast("int"))).otherwise(cut)


def render(detector: Column, path: Column, line_no: Column, line: Column, start: Column, end: Column, replacements: Column, description: Column, width: int = 80) -> Column:
    """The block of one finding: header, place, excerpt, marks with replacements, description."""
    digits = F.char_length(line_no.cast("string"))
    excerpt_ = _excerpt(line, start, end, F.lit(width) - (digits + 3))
    pad = F.repeat(F.lit(" "), digits)
    gutter = F.concat(pad, F.lit(" |"))
    head = F.concat(F.lit("error: "), F.lit("spellcheck("), detector, F.lit(")"))
    place = F.concat(pad, F.lit("--> "), path, F.lit(":"), line_no.cast("string"))
    about = F.when(description.isNotNull(), F.concat(gutter, F.lit("   "), description))

    def lines(x: Column) -> Column:
        marks = F.concat(gutter, F.lit(" "), F.repeat(F.lit(" "), x["at"]), F.repeat(F.lit("^"), x["n"]), replacements_text(replacements))
        return F.concat_ws("\n", head, place, gutter, F.concat(line_no.cast("string"), F.lit(" | "), x["text"]), marks, gutter, about)

    return let(excerpt_, lines)


def highlight(text: Column, start: Column, end: Column, context: int = 10) -> Column:
    """A range with context on both sides; out of bounds shows as !!!."""
    inside = (start <= end) & (end <= F.char_length(text))
    left = F.greatest(start - context, F.lit(0))
    shown = F.concat(F.substring(text, left + 1, start - left), F.lit(">"), F.substring(text, start + 1, end - start), F.lit("<"), F.substring(text, end + 1, F.lit(context)))
    return F.when(inside, shown).otherwise("!!!")
