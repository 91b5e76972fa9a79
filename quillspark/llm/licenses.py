"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, and a shunting-yard parser evaluates licence expressions.

Texts are scanned as words: with A-Z lower-cased, runs of ASCII letters and digits and of all other characters beyond
ASCII. The automaton holds all phrases, each between spaces, and runs once over the words joined by spaces; a phrase
counts wherever its words stand one after the other.

Phrases of BASE give the base labels, their places and counts. NOTICES give more labels. After an identifier tag (up to
the end of its line, or of the line that closes its parentheses) and after the words "licensed under", an expression of
identifiers, AND, OR, WITH and parentheses is read in the raw text, from where the words end; the parser brings it to
postfix order (WITH binds closest, then AND, then OR) and evaluates it to the labels it names and to the cost of the
cheapest choice: OR takes the lighter side, AND the heavier. A tag whose expression does not parse yields the
identifiers that can be read, joined as by AND. In prose the longest expression counts, and the identifiers that follow
in its sentence join it as by AND; line ends and comment marks do not end a sentence, and nor does its length, but a
full stop, a semicolon, an empty line after an expression, or the next tag or "licensed under" does.

score is 0 without labels; with some, 1 less the burden of what binds the text: 0.9 for permissive licences to 0.1
for licences that forbid commercial use.

Defined cases: null and empty texts have no words; the same phrase at several places counts each time; very long texts
are scanned whole. Ids are whole
numbers; others are an error (a null where ANSI mode is off). Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases, in words as they are scanned, and their labels.
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd",
    "bsd 2 clause": "bsd",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
#: Identifier tags: an expression follows.
TAGS = ("spdx license identifier",)
#: How much a label binds, from 0 to 1.
BURDEN = {"mit": 0.1, "bsd": 0.1, "apache-2": 0.15, "cc-by": 0.2, "mpl-2": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl-2": 0.7, "gpl-3": 0.7, "agpl": 0.8, "cc-by-nc": 0.9, "all-rights-reserved": 0.9}
OTHER = 0.6
_IDS = (("apache-2", "apache-2"), ("mit", "mit"), ("bsd", "bsd"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl-3", "gpl-3"), ("gpl-2", "gpl-2"), ("mpl-2", "mpl-2"), ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"))
_DELIMITERS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_FOLD = bytes.maketrans(_DELIMITERS + bytes(range(65, 91)), b" " * len(_DELIMITERS) + bytes(range(97, 123)))
#: The words of a tag and of UNDER where the automaton has them: between any characters that part words.
UNDER = ("licensed under", "licenced under")
_WORD, _GAP = r"[A-Za-z0-9\x80-\U0010FFFF]", r"[^A-Za-z0-9\x80-\U0010FFFF]+"
_HIT = re.compile(rf"(?<!{_WORD})(?:(?P<tag>{'|'.join(p.replace(' ', _GAP) for p in TAGS)})|{'|'.join(p.replace(' ', _GAP) for p in UNDER)})(?!{_WORD})", re.I | re.A)
_LINE = re.compile(r"[^\r\n]*(?:\r\n?|\n)?")
_EMPTY = r"(?:\r\n?|\n)[ \t/*#;%>!-]*(?=[\r\n])"
#: What prose is made of: identifiers whose dots are inside, parentheses, and what ends a sentence.
_PIECE = re.compile(rf"(?P<id>[A-Za-z0-9](?:[A-Za-z0-9+:-]|\.(?=[A-Za-z0-9]))*)|(?P<paren>[()])|(?P<empty>{_EMPTY})|(?P<stop>[.;])")
#: Words around identifiers in prose.
_AROUND = {"the", "a", "an", "either", "both", "any", "of", "terms", "term", "following", "license", "licence", "licenses", "licences"}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """The label of a licence identifier; one without a place in the table is its own label in lower case."""
    x = identifier.lower().rstrip(".")
    return next((label for prefix, label in _IDS if x == prefix or x.startswith((f"{prefix}-", f"{prefix}.", f"{prefix}+"))), x)


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: tokens in postfix order; ValueError if they are no expression."""
    out, stack, operand = [], [], True
    for t in tokens:
        low = t.lower()
        if t == "(":
            if not operand:
                raise ValueError("operator expected")
            stack.append(t)
        elif t == ")":
            if operand:
                raise ValueError("operand expected")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unbalanced")
            stack.pop()
        elif low in _BINDS:
            if operand:
                raise ValueError("operand expected")
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                raise ValueError("operator expected")
            out.append(t)
            operand = False
    if operand or "(" in stack:
        raise ValueError("incomplete")
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """(labels, burden) of an expression; WITH keeps its left side's burden, an exception lightens it by a fifth."""
    tokens = _TOKEN.findall(expression)
    try:
        order = postfix(tokens)
    except ValueError:
        found = [t for t in tokens if t not in "()" and t.lower() not in _BINDS and label_of(t) in BURDEN]
        order = found[:1] + [x for t in found[1:] for x in (t, "and")]
    stack: list[tuple[set[str], float]] = []
    for t in order:
        if t not in _BINDS:
            stack.append(({label_of(t)}, BURDEN.get(label_of(t), OTHER)))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            stack.append((left[0], 0.8 * left[1]))
        else:
            stack.append((left[0] | right[0], (min if t == "or" else max)(left[1], right[1])))
    return stack[0] if stack else (set(), 0.0)


def _sentence(text: str, start: int, end: int) -> list[str]:
    """Identifiers, operators and parentheses of the prose from start to the end of its sentence, without the words around them."""
    out, depth = [], 0
    for m in _PIECE.finditer(text, start, end):
        if m.lastgroup == "stop" or (m.lastgroup == "empty" and out and not depth and out[-1].lower() not in _BINDS):
            break
        if m.lastgroup == "paren" or (m.lastgroup == "id" and m[0].lower() not in _AROUND):
            out.append(m[0])
            depth = max(depth + {"(": 1, ")": -1}.get(m[0], 0), 0)
    return out


def _named(token: str) -> bool:
    """Whether a word of prose looks like an identifier: one of the table, or one with a digit or hyphen or in capitals."""
    return label_of(token) in BURDEN or bool(re.search(r"[0-9-]", token)) or (len(token) > 1 and token.isupper())


def _expression(tokens: list[str]) -> int:
    """The number of tokens in the longest expression they begin with."""
    depth, operand, longest = 0, True, 0
    for k, t in enumerate(tokens):
        if operand:
            if t == "(":
                depth += 1
                continue
            if t == ")" or t.lower() in _BINDS or not _named(t):
                break
            operand = False
        elif t == ")":
            if not depth:
                break
            depth -= 1
        elif t.lower() in _BINDS:
            operand = True
            continue
        else:
            break
        if not depth:
            longest = k + 1
    return longest


def evaluate_prose(tokens: list[str]) -> tuple[set[str], float]:
    """(labels, burden) of a sentence: only identifiers of the table give labels."""
    try:
        postfix(tokens)
        n = len(tokens)
    except ValueError:
        n = _expression(tokens)
    labels, burden = evaluate(" ".join(tokens[:n]))
    rest = {label_of(t) for t in tokens[n:]} & BURDEN.keys()
    return (labels & BURDEN.keys()) | rest, max([burden, *(BURDEN[x] for x in rest)])


def _tagged(text: str, start: int, end: int) -> str:
    """The line from start, and the lines after it up to the one that closes its parentheses, if one does before an empty line."""
    first = at = _LINE.match(text, start, end).end()
    depth = text.count("(", start, at) - text.count(")", start, at)
    while depth > 0 and at < end:
        stop = _LINE.match(text, at, end).end()
        if not re.search("[A-Za-z0-9()]", text[at:stop]):
            break
        depth += text.count("(", at, stop) - text.count(")", at, stop)
        at = stop
    return text[start : at if depth <= 0 else first]


def expressions(text: str) -> Iterator[tuple[set[str], float]]:
    """(labels, burden) after each tag and "licensed under"."""
    hits = list(_HIT.finditer(text))
    for m, end in zip(hits, [*(h.start() for h in hits[1:]), len(text)], strict=True):
        if m["tag"]:
            yield evaluate(_tagged(text, re.compile(r"\s*:?[ \t]*").match(text, m.end(), end).end(), end))
        else:
            yield evaluate_prose(_sentence(text, m.end(), end))


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, what in [*((p, ("tag", None)) for p in TAGS), *((p, ("notice", label)) for p, label in NOTICES.items()), *((p, ("under", None)) for p in UNDER), *((p, ("base", label)) for p, label in BASE.items())]:
        a.add_word(f" {phrase} ", (phrase.count(" ") + 1, *what))
    a.make_automaton()
    return a


_AUTOMATON = automaton()


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    line = f" {b' '.join(words).decode('latin-1')} "
    starts, base, more, burdens, kinds = [], set(), set(), [], set()
    spaces = at = 0  # spaces before at: hits come in the order of their ends
    for end, (n, kind, label) in _AUTOMATON.iter(line):
        kinds.add(kind)
        if kind == "base":
            spaces, at = spaces + line.count(" ", at, end + 1), end + 1
            starts.append(spaces - n - 1)
            base.add(label)
        elif kind == "notice":
            more.add(label)
    if kinds & {"tag", "under"}:
        for labels, burden in expressions(text):
            if labels:
                more |= labels
                burdens.append((labels, burden))
    labels = base | more
    own = [BURDEN.get(x, OTHER) for x in labels if not any(x in of for of, _ in burdens)] + [b for _, b in burdens]
    score = round(1 - max(own), 6) if labels else 0.0
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [scan(x.as_py()) for x in b.column(1)]
        columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OUT)]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *_OUT.names])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _batches, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
