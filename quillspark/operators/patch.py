"""Decisions become patches, patches become text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind(s: Column, given: Column | None = None, legacy: bool = False) -> Column:
    """Insert or Replace: as given; legacy takes every span of one character for an insertion."""
    one = (s["start"]["line"] == s["end"]["line"]) & (s["start"]["col"] == s["end"]["col"])
    if legacy:
        return F.when(one, "Insert").otherwise("Replace")
    return F.coalesce(given, F.lit("Replace")) if given is not None else F.lit("Replace")


def apply(texts: DataFrame, patches: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text with all patches (id_col, start, end, content: replaced range, empty for an insertion) in one pass.

    Pieces between patches come from the end of the patch before; texts without patches stay as they are. Patches of a
    text must not overlap; insertions at one place keep the order of their content.
    """
    own = patches.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "content"))).alias("ps"))
    joined = texts.select(id_col, text_col).join(own, id_col, "left")
    text = F.col(text_col)
    froms = F.concat(F.array(F.lit(0)), F.transform("ps", lambda p: p["end"].cast("int")))
    pieces = F.zip_with("ps", F.slice(froms, F.lit(1), F.size("ps")), lambda p, at: F.concat(F.substring(text, at + 1, p["start"] - at), p["content"]))
    rest = F.substring(text, F.get("ps", F.size("ps") - 1)["end"] + 1, F.char_length(text))
    return joined.select(id_col, F.when(F.col("ps").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest)).alias(text_col))


def first_replacements(found: DataFrame) -> DataFrame:
    """The patch of each finding that has a replacement: its first."""
    return found.filter(F.size("replacements") > 0).withColumn("content", F.get("replacements", F.lit(0)))


def back_ticked(word: Column) -> Column:
    return F.concat(F.lit("`"), word, F.lit("`"))


def decide(found: DataFrame, decisions: DataFrame, order: list[str], origin: str = "doc_id") -> DataFrame:
    """Findings with the content that their decision asks for, in the order in which they are decided.

    found: finding_id, origin, word, replacements and the columns of order, which is a total order. decisions:
    finding_id, choice, custom. choice: a number (that replacement, from 1), "original" (the word in back ticks),
    "custom", "skip", "skip_file" (nothing more of this origin from here on), "quit" (nothing from here on), "abort"
    (nothing at all). Findings without replacements are not asked about, those without a decision are skipped.
    """
    d = found.join(decisions, "finding_id", "left").withColumn("choice", F.coalesce("choice", F.lit("skip")))
    at = F.struct(*[F.col(c) for c in order])
    quit_at = d.agg(F.min(F.when(F.col("choice") == "quit", at))).scalar()
    aborted = d.agg(F.max(F.when(F.col("choice") == "abort", 1))).scalar()
    skips = d.filter("choice = 'skip_file'").groupBy(F.col(origin).alias("__origin")).agg(F.min(at).alias("skip"))
    rows = d.join(skips, F.col(origin) == F.col("__origin"), "left").drop("__origin")
    rows = rows.filter(aborted.isNull() & (quit_at.isNull() | (at < quit_at)) & (F.col("skip").isNull() | (at < F.col("skip"))))
    number = F.col("choice").rlike("^[0-9]+$")
    content = F.when(number, F.get("replacements", F.when(number, F.col("choice")).cast("int") - 1)).when(F.col("choice") == "original", back_ticked(F.col("word"))).when(F.col("choice") == "custom", F.col("custom"))
    return rows.withColumn("content", content).filter((F.col("content").isNotNull()) & (F.size("replacements") > 0)).drop("skip")
