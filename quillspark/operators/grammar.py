"""Grammar rules as data: a rule names a pattern, a message, a category and what the match should be.

Rules come from a table, from files of JSON lines, or from the few that come with this package. Replacements name groups
of the pattern as $1, the whole match as $0.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.positions import explode_rows, let, running_sums
from . import cmark
from .chunks import Placed
from .tokens import words

SKIPPED = ("misspelling", "typographical")
RULES = "rule_id string, category string, pattern string, message string, replacement string"
#: Patterns over a whole text; each match is a finding.
TEXT_RULES = [
    ("space_before_mark", "Punctuation", r"([\p{L}\p{N}]) +([,.;:!?])", "No space belongs before the mark.", "$1$2"),
    ("no_space_after_comma", "Punctuation", r"(\p{L}),(\p{L})", "A space belongs after the comma.", "$1, $2"),
    ("repeated_mark", "Punctuation", r"([,;])[,;]+", "The mark is repeated.", "$1"),
    ("shouting", "Style", r"!{2,}", "One mark is enough.", "!"),
    ("double_space", "Typographical", r"\p{L} {2,}\p{L}", "Two spaces.", None),
    ("teh", "Misspelling", r"\bteh\b", "the", "the"),
]
#: Patterns over neighbouring words.
WORD_RULES = [
    ("doubled_word", "Grammar", r"(?i)(?<![\p{L}\p{M}\p{N}_])([\p{L}\p{M}\p{N}_]+)\s+\1(?![\p{L}\p{M}\p{N}_])", "The word stands twice.", "$1"),
    ("a_before_vowel", "Grammar", r"(?<![\p{L}\p{M}\p{N}_])[Aa](?=\s+[aeiouAEIOU])", "An stands before a vowel.", "$0n"),
    ("an_before_consonant", "Grammar", r"(?<![\p{L}\p{M}\p{N}_])([Aa])n(?=\s+(?![aeiouAEIOU])[a-zA-Z])", "A stands before a consonant.", "$1"),
]


def rule_table(spark: SparkSession, rules=(*TEXT_RULES, *WORD_RULES)) -> DataFrame:
    return spark.createDataFrame([(*r, None)[:5] for r in rules], RULES)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file of JSON lines; what a line leaves out is null, and one without a pattern is no rule."""
    return spark.read.schema(RULES).json(path).filter("pattern is not null")


def active(rules: DataFrame, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Rules whose category is not skipped, whatever its case."""
    return rules.filter(~F.lower("category").isin(*[s.lower() for s in skipped]))


def matches(texts: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, rule_id, message, start, end, replacement: every match of every rule. Rules are a small table, read on the driver once.

    Each text is scanned once for each rule, in expressions of one projection; no join of texts with rules is needed.
    """
    found = []
    for r in rules.orderBy("rule_id").collect():
        pieces = F.split(F.col(text_col), r["pattern"])
        hits = F.regexp_extract_all(F.col(text_col), F.lit(r["pattern"]), F.lit(0))
        made = F.lit(None).cast("array<string>") if r["replacement"] is None else F.transform(hits, lambda h: F.regexp_replace(h, r["pattern"], r["replacement"]))  # noqa: B023
        found.append(F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["message"]).alias("message"), hits.alias("hits"), F.slice(pieces, F.lit(1), F.size(hits)).alias("gaps"), made.alias("made")))
    if not found:
        return texts.select(id_col, F.lit("").alias("rule_id"), F.lit("").alias("message"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("replacement")).filter("false")
    rows = texts.select(id_col, F.explode(F.array(*found)).alias("r")).filter("size(r.hits) > 0")
    sizes = F.zip_with(F.col("r.hits"), F.col("r.gaps"), lambda h, g: F.struct(F.char_length(h).alias("n"), F.char_length(g).alias("gap")))
    placed = let(sizes, lambda xs: F.zip_with(xs, running_sums(F.transform(xs, lambda x: x["n"] + x["gap"])), lambda x, at: F.struct((at + x["gap"]).alias("start"), x["n"].alias("n"))))
    rows = explode_rows(rows.select(id_col, "r.rule_id", "r.message", "r.made", placed.alias("p")), [id_col, "rule_id", "message", "made"], F.col("p"), "k")
    start = F.col("x.start").cast("int")
    return rows.select(id_col, "rule_id", "message", start.alias("start"), (start + F.col("x.n")).cast("int").alias("end"), F.get("made", F.col("k").cast("int")).alias("replacement"))


def placed_matches(chunks: DataFrame, rules: DataFrame, ignore_footnotes: bool = False) -> DataFrame:
    """origin_id, chunk_idx, start, end, start_line, start_col, end_line, end_col, word, rule_id, message, replacement: matches in chunks' plain text.

    Ranges are of the chunk's text, places of its origin; matches that begin in an alias have none and are left out. All
    rules are tried in one pass over a chunk: its text goes nowhere else.
    """
    schema = "origin_id string, chunk_idx int, start int, end int, start_line int, start_col int, end_line int, end_col int, word string, rule_id string, message string, replacement string"
    told = [(r["rule_id"], r["pattern"], r["message"], None if r["replacement"] is None else regex.sub(r"\$(\d+)", r"\\g<\1>", r["replacement"].replace("\\", "\\\\"))) for r in rules.orderBy("rule_id").collect()]
    kinds = [pa.int32()] * 6 + [pa.string()] * 4

    def of(text: str, mapping: list[dict], compiled: list[tuple]) -> Iterator[tuple]:
        plain, maps = cmark.erase(text, ignore_footnotes)
        placed, starts = Placed(text, mapping), [p[0] for p, _, _ in maps]
        for rule_id, pattern, message, replacement in compiled:
            for m in pattern.finditer(plain):
                k = bisect_right(starts, m.start()) - 1
                if m.start() == m.end() or k < 0 or maps[k][0][1] <= m.start() or maps[k][2] is not None:
                    continue
                (p, _), (r, end), _ = maps[k]
                first, last = r + m.start() - p, min(r + m.end() - p, end)
                if first < last:
                    yield first, last, *placed.place(first), *placed.place(last - 1), m[0], rule_id, message, replacement and m.expand(replacement)

    def batch(b: pa.RecordBatch, rows: list[tuple], at: list[int]) -> pa.RecordBatch:
        columns = [b.column(k).take(pa.array(at, pa.int64())) for k in range(2)]
        columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(i, regex.compile(p), m, r) for i, p, m, r in told]
        for b in batches:
            rows, at = [], []
            for k, (text, mapping) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                own = list(of(text, mapping, compiled))
                rows += own
                at += [k] * len(own)
                if len(rows) > 50_000:  # a batch of long chunks goes on in parts
                    yield batch(b, rows, at)
                    rows, at = [], []
            yield batch(b, rows, at)

    return chunks.filter(F.size("source_mapping") > 0).select("origin_id", F.col("chunk_idx").cast("int"), "text", "source_mapping").mapInArrow(run, schema)


def _with_next(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, tok_idx, word, next_word (null for the last): neighbours within the row."""
    pairs = let(words(F.col(text_col)), lambda w: F.arrays_zip(w.alias("w"), F.slice(w, F.lit(2), F.size(w)).alias("n")))
    rows = explode_rows(texts, [id_col], pairs, "tok_idx")
    return rows.select(id_col, "tok_idx", F.col("x.w").alias("word"), F.col("x.n").alias("next_word"))


def doubled_words(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words that stand twice in a row, whatever their case: id_col, tok_idx of the second, word."""
    rows = _with_next(texts, id_col, text_col).filter(F.lower("word") == F.lower("next_word"))
    return rows.select(id_col, (F.col("tok_idx") + 1).alias("tok_idx"), F.col("next_word").alias("word"))


def a_or_an(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a before a vowel letter, an before another: id_col, tok_idx, word, next_word, replacement."""
    vowel = F.lower("next_word").rlike("^[aeiou]")
    wrong = ((F.lower("word") == "a") & vowel) | ((F.lower("word") == "an") & ~vowel)
    return _with_next(texts, id_col, text_col).filter(wrong).select(id_col, "tok_idx", "word", "next_word", F.when(vowel, "an").otherwise("a").alias("replacement"))
