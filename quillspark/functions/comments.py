"""Comment variants: their categories, prefixes, suffixes and spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOC = ("TripleSlash", "DoubleSlashEM", "MacroDocEqStr", "MacroDocEqMacro", "SlashAsteriskEM", "SlashAsteriskAsterisk")
VARIANTS = (*DOC, "CommonMark", "TomlEntry", "DoubleSlash", "SlashStar", "SlashAsterisk", "Unknown")
_PREFIX = {"TripleSlash": "///", "DoubleSlashEM": "//!", "DoubleSlash": "//", "SlashStar": "/*", "SlashAsterisk": "/*", "SlashAsteriskEM": "/*!", "SlashAsteriskAsterisk": "/**"}
_CLOSED = ("SlashAsterisk", "SlashAsteriskEM", "SlashAsteriskAsterisk")


def category(tag: Column) -> Column:
    """Doc, Dev, CommonMark or Unmergable."""
    return F.when(tag.isin(*DOC), "Doc").when(tag == "CommonMark", "CommonMark").when(tag == "TomlEntry", "Unmergable").otherwise("Dev")


def _hashes(n: Column) -> Column:
    return F.repeat(F.lit("#"), F.greatest(n - 1, F.lit(0)))


def prefix(tag: Column, doc_prefix: Column, hashes: Column) -> Column:
    out = F.when(tag == "MacroDocEqStr", F.concat(doc_prefix, F.when(hashes == 0, F.lit('"')).otherwise(F.concat(F.lit("r"), _hashes(hashes), F.lit('"')))))
    for t, p in _PREFIX.items():
        out = out.when(tag == t, p)
    return out.otherwise("")


def suffix(tag: Column, hashes: Column) -> Column:
    raw = F.when(hashes <= 1, F.lit('"]')).otherwise(F.concat(F.lit('"'), _hashes(hashes), F.lit("]")))
    return F.when(tag == "MacroDocEqStr", raw).when(tag.isin(*_CLOSED), "*/").otherwise("")


def marks(tag: str, doc_prefix: str | None, hashes: int) -> tuple[str, str]:
    """prefix and suffix of one literal, as plain text."""
    if tag == "MacroDocEqStr":
        raw = "#" * max(hashes - 1, 0)
        return f'{doc_prefix or ""}{"r" if hashes else ""}{raw}"', f'"{raw}]'
    return _PREFIX.get(tag, ""), "*/" if tag in _CLOSED else ""


def prefix_len(tag: Column, doc_prefix: Column, hashes: Column) -> Column:
    """Bytes before the text."""
    return F.when(tag == "MacroDocEqStr", F.octet_length(doc_prefix) + hashes + 1).otherwise(F.octet_length(prefix(tag, doc_prefix, hashes))).cast("int")


def suffix_len(tag: Column, hashes: Column) -> Column:
    return F.when(tag == "MacroDocEqStr", F.when(hashes == 0, 2).otherwise(hashes + 1)).when(tag.isin(*_CLOSED), 2).otherwise(0).cast("int")


def trim_span(s: Column, pre: Column, post: Column) -> Column:
    """A literal's span without its prefix and suffix; an end before the line's first column goes to the line above."""
    back = s["end"]["col"] >= post
    end = F.when(back, F.struct(s["end"]["line"].alias("line"), (s["end"]["col"] - post).alias("col"))).otherwise(F.struct((s["end"]["line"] - 1).alias("line"), F.lit(0).alias("col")))
    return F.struct(F.struct(s["start"]["line"].alias("line"), (s["start"]["col"] + pre).alias("col")).alias("start"), end.alias("end"))


def kind_of_line(text: Column) -> Column:
    """block, line or other for a comment token: doc comments are other."""
    return F.when(text.rlike(r"^/\*(?s:.*)\*/$"), "block").when(text.rlike(r"^//([^/|!]|$)"), "line").otherwise("other")
