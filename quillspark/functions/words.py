"""Predicates on words, and what a dictionary or a language name must look like."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One-character tokens that are never looked up.
SPLIT_CHARS = "!\"#&'(),-./:;?@[]_`{|}§¶‒…"
#: Code points with the emoji property, digits, # and * among them, and the marks that join them.
EMOJI = r"#*0-9\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2604}\x{260E}\x{2611}\x{2614}\x{2615}\x{2618}\x{261D}\x{2620}\x{2622}\x{2623}\x{2626}\x{262A}\x{262E}\x{262F}\x{2638}-\x{263A}\x{2640}\x{2642}\x{2648}-\x{2653}\x{265F}\x{2660}\x{2663}\x{2665}\x{2666}\x{2668}\x{267B}\x{267E}\x{267F}\x{2692}-\x{2697}\x{2699}\x{269B}\x{269C}\x{26A0}\x{26A1}\x{26A7}\x{26AA}\x{26AB}\x{26B0}\x{26B1}\x{26BD}\x{26BE}\x{26C4}\x{26C5}\x{26C8}\x{26CE}\x{26CF}\x{26D1}\x{26D3}\x{26D4}\x{26E9}\x{26EA}\x{26F0}-\x{26F5}\x{26F7}-\x{26FA}\x{26FD}\x{2702}\x{2705}\x{2708}-\x{270D}\x{270F}\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}\x{2764}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F004}\x{1F0CF}\x{1F170}-\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1E6}-\x{1F1FF}\x{1F201}\x{1F202}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F250}\x{1F251}\x{1F300}-\x{1F321}\x{1F324}-\x{1F393}\x{1F396}\x{1F397}\x{1F399}-\x{1F39B}\x{1F39E}-\x{1F3F0}\x{1F3F3}-\x{1F3F5}\x{1F3F7}-\x{1F4FD}\x{1F4FF}-\x{1F53D}\x{1F549}-\x{1F54E}\x{1F550}-\x{1F567}\x{1F56F}\x{1F570}\x{1F573}-\x{1F57A}\x{1F587}\x{1F58A}-\x{1F58D}\x{1F590}\x{1F595}\x{1F596}\x{1F5A4}\x{1F5A5}\x{1F5A8}\x{1F5B1}\x{1F5B2}\x{1F5BC}\x{1F5C2}-\x{1F5C4}\x{1F5D1}-\x{1F5D3}\x{1F5DC}-\x{1F5DE}\x{1F5E1}\x{1F5E3}\x{1F5E8}\x{1F5EF}\x{1F5F3}\x{1F5FA}-\x{1F64F}\x{1F680}-\x{1F6C5}\x{1F6CB}-\x{1F6D2}\x{1F6D5}-\x{1F6D7}\x{1F6DC}-\x{1F6E5}\x{1F6E9}\x{1F6EB}\x{1F6EC}\x{1F6F0}\x{1F6F3}-\x{1F6FC}\x{1F7E0}-\x{1F7EB}\x{1F7F0}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1F9FF}\x{1FA70}-\x{1FA7C}\x{1FA80}-\x{1FA89}\x{1FA8F}-\x{1FAC6}\x{1FACE}-\x{1FADC}\x{1FADF}-\x{1FAE9}\x{1FAF0}-\x{1FAF8}"
FRACTIONS = r"\x{BC}-\x{BE}\x{2150}-\x{215E}\x{2189}"


def is_split_char(token: Column, chars: str = SPLIT_CHARS) -> Column:
    return (F.char_length(token) == 1) & (F.instr(F.lit(chars), token) > 0)


def is_emoji(word: Column) -> Column:
    """A vulgar fraction anywhere, or nothing but emoji."""
    return word.rlike(f"[{FRACTIONS}]") | word.rlike(f"^[{EMOJI}]+$")


def is_concatenation(word: Column, replacements: Column) -> Column:
    """A word with dashes of which a replacement is the same without."""
    return F.contains(word, F.lit("-")) & F.array_contains(replacements, F.replace(word, F.lit("-"), F.lit("")))


def is_dashed_elsewhere(word: Column, replacements: Column) -> Column:
    """A word without dashes that a replacement splits by dashes."""
    same = F.exists(replacements, lambda r: (F.left(r, F.lit(1)) == F.left(word, F.lit(1))) & F.contains(r, F.lit("-")) & (F.replace(r, F.lit("-"), F.lit("")) == word))
    return ~F.contains(word, F.lit("-")) & same


def is_ordinal(word: Column) -> Column:
    """Numbers with the ending that belongs to them: 11th, 21st, 102nd."""
    return word.rlike("^[0-9]*1[0-9]th$") | word.rlike("^([0-9]*[02-9])?(1st|2nd|3rd|[04-9]th)$")


def is_dictionary(content: Column) -> Column:
    """Whether a word list starts with a count and then with words: its next ten lines are no numbers."""
    lines = F.split(content, "\r?\n")
    words = F.slice(lines, 2, 10)
    return F.trim(F.get(lines, F.lit(0))).rlike(r"^\+?[0-9]+$") & ~F.exists(words, lambda x: F.trim(x).rlike("^[+-]?[0-9]+$"))


def is_language_tag(tag: Column) -> Column:
    return tag.rlike("^[a-z]{2}_[A-Z]{2}$")


def transform(word: str, patterns: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    """(outcome, fragments) of one word: the first pattern that matches decides, and fragments are taken apart again.

    outcome: "whitelisted" (a pattern without groups matched and nothing is left), "atomic" (no pattern matched) or "fragments".
    A pattern that is no valid expression ends the list for the word. A fragment that is the whole word again is final;
    any other is shorter, so taking apart ends whatever the patterns are.
    """
    todo, out, listed = deque([(0, word)]), [], False
    while todo:
        at, w = todo.popleft()
        for p in patterns:
            try:
                m = regex.search(p, w)
            except regex.error:
                out.append((at, at + len(w), w))
                break
            if not m:
                continue
            groups = [(m.start(g), m.end(g), m[g]) for g in range(1, m.re.groups + 1) if m[g]]
            if m.re.groups == 0:
                listed = True
            for s, e, g in groups:
                if g == w:
                    out.append((at + s, at + e, g))
                else:
                    todo.append((at + s, g))
            break
        else:
            out.append((at, at + len(w), w))
    out.sort()
    if not listed and len(out) == 1 and len(out[0][2]) == len(word):
        return "atomic", out
    return ("fragments", out) if out else ("whitelisted", [])


_FRAGMENT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])


def _transform_part(words: list[str], patterns: list[str], outcomes: set[str] | None) -> tuple[list[int], list[str], list[list[dict]]]:
    """Which of the words have one of the outcomes, that outcome, and their fragments. Words that no pattern matches, most of them, go no further than that."""
    compiled = []
    for p in patterns:
        try:
            compiled.append(regex.compile(p).search)
        except regex.error:
            break  # for a word that none before matches, the list ends here
    at, outcome, fragments = [], [], []
    for k, w in enumerate(words):
        said, parts = transform(w, patterns) if any(f(w) for f in compiled) else ("atomic", [(0, len(w), w)])
        if outcomes is None or said in outcomes:
            at.append(k)
            outcome.append(said)
            fragments.append([{"start": s, "end": e, "text": t} for s, e, t in parts])
    return at, outcome, fragments


def transformed(rows: DataFrame, patterns: list[str], outcomes: set[str] | None = None, word: str = "word") -> DataFrame:
    """word, outcome, fragments: transform() of each row's word, of those rows that have one of the outcomes, if any are named."""
    schema = f"`{word}` string, outcome string, fragments array<struct<start:int,end:int,text:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, outcome, fragments = _transform_part(b.column(0).to_pylist(), patterns, outcomes)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(outcome, pa.string()), pa.array(fragments, pa.list_(_FRAGMENT))], names=[word, "outcome", "fragments"])

    return rows.select(word).mapInArrow(run, schema)
