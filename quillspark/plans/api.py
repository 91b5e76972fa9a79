"""The actions: check, reflow, fix, list origins. Each takes origins as rows and returns rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import positions
from ..functions import words as W
from ..operators import chunks as C
from ..operators import cmark, findings, grammar, patch, reflow, report, rustlex, spell, tokens
from ..tables import settled
from .config import Config


@dataclass
class Context:
    """What checkers need besides chunks: forms of the lexicon, replacement pairs, rules and settings."""

    forms: DataFrame
    pairs: DataFrame | None = None
    rules: DataFrame | None = None
    config: Config = field(default_factory=Config)
    #: More checkers by detector's name: (chunks, context) -> FOUND, or FOUND without PLACE.
    more: dict[str, Callable[[DataFrame, Context], DataFrame]] = field(default_factory=dict)


KEYS = ("origin_id", "chunk_idx")
#: The columns of findings: keys, the range in the chunk's text, the place in the origin, and what is said of it.
FOUND = (*KEYS, "start", "end", *findings.PLACE, "word", "replacements", "detector", "description")


def chunks(origins: DataFrame, dev_comments: bool = False) -> DataFrame:
    """Chunks of Rust origins and of all others, which are read as Markdown."""
    rust = C.chunks(rustlex.extract(origins.filter("kind = 'rust'"), True, dev_comments))
    text = C.markdown_chunks(origins.filter("kind <> 'rust' and kind <> 'manifest'"))
    return rust.unionByName(text)


def unreadable(origins: DataFrame) -> DataFrame:
    """origin_id, error: the Rust origins that do not lex. They have no chunks; each is an error of its file."""
    return rustlex.extract(origins.filter("kind = 'rust'")).filter("category = 'Error'").select("origin_id", F.col("text").alias("error"))


def placed(found: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Findings (KEYS, start, end in the chunk's text) with the lines and columns of their origin.

    A line's column is counted from its fragment's: comments have a fragment for each line, Markdown one for all of them.
    """
    found = found.join(chunk_rows.select(*KEYS, "text", "source_mapping"), list(KEYS))
    own = F.get(F.filter("source_mapping", lambda m: (m["range"]["start"] <= F.col("start")) & (F.col("start") < m["range"]["end"])), F.lit(0))
    found = found.withColumn("__own", own).filter("__own is not null")
    inside = lambda at: F.substring(F.col("text"), F.col("__own.range.start") + 1, at - F.col("__own.range.start"))
    line = lambda at: F.col("__own.span.start.line") + F.char_length(inside(at)) - F.char_length(F.replace(inside(at), F.lit("\n"), F.lit("")))
    tail = lambda at: F.char_length(F.substring_index(inside(at), "\n", -1))
    col = lambda at: F.when(line(at) == F.col("__own.span.start.line"), F.col("__own.span.start.col") + tail(at)).otherwise(tail(at))
    last = F.col("end") - 1
    out = found.withColumn("start_line", line(F.col("start")).cast("int")).withColumn("start_col", col(F.col("start")).cast("int")).withColumn("end_line", line(last).cast("int")).withColumn("end_col", col(last).cast("int"))
    return out.drop("__own", "text", "source_mapping")


def flagged(tokens_: DataFrame, forms: DataFrame, detector: str) -> DataFrame:
    """The tokens (with a column word) that one of the spell checkers flags.

    hunspell meets all spellings of a word at once; zspell and spellbook try one spelling after the other.
    """
    if detector == "hunspell":
        return spell.misspelled(tokens_, forms)
    return spell.misspelled_in_turn(tokens_, forms)


def spelling(chunk_rows: DataFrame, ctx: Context, detector: str = "hunspell") -> DataFrame:
    """Unknown words of chunks with their places and replacements (only hunspell has them).

    Chunks are parsed twice, once for the distinct words and once for their places, rather than keep a row for each
    token of the corpus; the unknown words themselves, of which replacements are sought, are kept as a table.
    """
    section = getattr(ctx.config, detector) or ctx.config.hunspell
    quirks = section.quirks
    toks = tokens.placed_words(chunk_rows, quirks.transform_regex, not quirks.check_footnote_references)
    toks = toks.filter(~W.is_split_char(F.col("word"), section.tokenization_splitchars) & F.col("word").rlike(r"[\p{L}\p{N}]"))
    bad = spell.unknown(toks, ctx.forms)
    none = F.array().cast("array<string>")
    if detector == "hunspell":
        bad = settled(bad)
        near = spell.candidates(bad, ctx.forms).select("word", F.lit(1).alias("by"), "rank", "form")
        if ctx.pairs is not None:
            near = near.union(spell.replaced(bad, ctx.pairs, ctx.forms).select("word", F.lit(0), F.lit(0), "form"))
        near = near.filter(F.octet_length("form") > 1).groupBy("word").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("by", "rank", "form"))), lambda x: x["form"])).alias("replacements"))
        bad = bad.join(near, "word", "left").withColumn("replacements", F.coalesce("replacements", none))
    else:
        bad = bad.withColumn("replacements", none)
    bad = spell.quirks(bad, quirks.allow_emojis, quirks.allow_concatenation, quirks.allow_dashes)
    return toks.join(bad, "word").select(*FOUND[:-2], F.lit(detector).alias("detector"), F.lit(None).cast("string").alias("description"))


def grammar_findings(chunk_rows: DataFrame, ctx: Context) -> DataFrame:
    rules = ctx.rules if ctx.rules is not None else grammar.rule_table(chunk_rows.sparkSession)
    rows = grammar.placed_matches(chunk_rows, grammar.active(rules))
    own = F.when(F.col("replacement").isNull(), F.array().cast("array<string>")).otherwise(F.array("replacement"))
    return rows.withColumn("replacements", own).select(*FOUND[:-2], F.lit("nlprules").alias("detector"), F.col("message").alias("description"))


def dummy(chunk_rows: DataFrame, ctx: Context) -> DataFrame:
    """A checker that finds fault with every token, to try out what comes after checkers."""
    made = F.array(F.concat(F.lit("replacement_"), F.col("tok_idx").cast("string")))
    rows = tokens.placed_words(chunk_rows).withColumn("replacements", made)
    return rows.select(*FOUND[:-2], F.lit("dummy").alias("detector"), F.lit(None).cast("string").alias("description"))


def check(origins: DataFrame, ctx: Context) -> DataFrame:
    """Findings of all enabled checkers with their places, in order and without overlaps."""
    chunk_rows = chunks(origins, ctx.config.dev_comments)
    found = [grammar_findings(chunk_rows, ctx) if n == "nlprules" else spelling(chunk_rows, ctx, n) for n in ctx.config.enabled() if n != "reflow"]
    for checker in ctx.more.values():
        own = checker(chunk_rows, ctx)
        found.append((own if set(findings.PLACE) <= set(own.columns) else placed(own, chunk_rows)).select(*FOUND))
    if not found:
        raise ValueError("no checker is enabled")
    return findings.without_overlaps(findings.union(*found)).orderBy(*findings.in_order())


def reflowed(origins: DataFrame, config: Config | None = None) -> DataFrame:
    """KEYS, start, end, start_line, start_col, end_line, end_col, replacement: the paragraphs that wrapping to the width changes. Block comments are left alone."""
    config = config or Config()
    width = config.reflow.max_line_length if config.reflow else reflow.WIDTH
    endings = origins.select("origin_id", positions.dominant_delimiter(F.col("content")).alias("delimiter")).dropDuplicates(["origin_id"])
    return reflow.reflow_chunks(chunks(origins, config.dev_comments).join(endings, "origin_id", "left"), width)


def patched(origins: DataFrame, found: DataFrame) -> DataFrame:
    """origin_id, content: texts with the places of found (PLACE, content) replaced."""
    lines = positions.line_table(origins, "origin_id", "content").select("origin_id", F.col("line_no").alias("start_line"), "start_off")
    at = found.join(lines, ["origin_id", "start_line"]).withColumn("s", F.col("start_off") + F.col("start_col")).drop("start_off")
    ends = lines.withColumnRenamed("start_line", "end_line")
    at = at.join(ends, ["origin_id", "end_line"]).withColumn("e", F.col("start_off") + F.col("end_col") + 1)
    return patch.apply(origins, at.select("origin_id", F.col("s").alias("start"), F.col("e").alias("end"), "content"), "origin_id", "content")


def fix(origins: DataFrame, found: DataFrame, decisions: DataFrame) -> DataFrame:
    """origin_id, content: texts with what the decisions ask for. found: check() with a finding_id."""
    return patched(origins, patch.decide(found, decisions, ["origin_id", *findings.PLACE, "finding_id"], "origin_id"))


def rewrapped(origins: DataFrame, config: Config | None = None) -> DataFrame:
    """origin_id, content: texts with all their paragraphs wrapped."""
    return patched(origins, reflowed(origins, config).withColumnRenamed("replacement", "content"))


def identified(found: DataFrame) -> DataFrame:
    """found with finding_id: origin, place and detector, the same on each run."""
    return found.withColumn("finding_id", F.concat_ws(":", "origin_id", *findings.PLACE, "detector"))


def blocks(origins: DataFrame, found: DataFrame, width: int = 80) -> DataFrame:
    """origin_id, the place and block (the text that shows it) of each finding; of one over several lines, its first is shown."""
    lines = positions.line_table(origins, "origin_id", "content").select("origin_id", F.col("line_no").alias("start_line"), "line")
    names = origins.select("origin_id", F.coalesce("path", "origin_id").alias("path")).dropDuplicates(["origin_id"])
    rows = found.join(lines, ["origin_id", "start_line"]).join(names, "origin_id")
    end = F.when(F.col("end_line") == F.col("start_line"), F.col("end_col") + 1).otherwise(F.char_length("line"))
    block = report.render(F.col("detector"), F.col("path"), F.col("start_line"), F.col("line"), F.col("start_col"), end, F.col("replacements"), F.col("description"), width)
    return rows.select("origin_id", *findings.PLACE, "detector", "replacements", block.alias("block"))


def list_origins(origins: DataFrame) -> DataFrame:
    return origins.select(F.coalesce("path", "origin_id").alias("path")).distinct().orderBy("path")


verdict = findings.verdict
