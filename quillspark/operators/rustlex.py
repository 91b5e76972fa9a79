"""Comments and doc attributes of Rust sources as literals, from a lexer that knows strings, raw strings, nested block comments, characters and lifetimes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import schema
from .batches import in_parts

_RAW = re.compile(r'(?:br|cr|r)(#*)"')
_CHAR = re.compile(r"b?'(?:\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\})|[^'\\\n])'")
_DOC = re.compile(r"#\s*!?\s*\[\s*doc\s*=\s*")
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def lex(src: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the tokens that matter: line, block, string, raw, ident, punct."""
    k, n = 0, len(src)
    while k < n:
        c = src[k]
        if src.startswith("//", k):
            e = src.find("\n", k)
            e = n if e < 0 else e - 1 if src[e - 1] == "\r" else e
            yield "line", k, e
        elif src.startswith("/*", k):
            depth, e = 1, k + 2
            while e < n and depth:
                if src.startswith("/*", e):
                    depth, e = depth + 1, e + 2
                elif src.startswith("*/", e):
                    depth, e = depth - 1, e + 2
                else:
                    e += 1
            if depth:
                raise ValueError("a block comment is not closed")
            yield "block", k, e
        elif m := _RAW.match(src, k):
            close = '"' + m[1]
            e = src.find(close, m.end())
            if e < 0:
                raise ValueError("a raw string is not closed")
            e += len(close)
            yield "raw", k, e
        elif c == '"' or (c in "bc" and src.startswith('"', k + 1)):
            e = k + 1 if c == '"' else k + 2
            while e < n and src[e] != '"':
                e += 2 if src[e] == "\\" else 1
            if e >= n:
                raise ValueError("a string is not closed")
            e += 1
            yield "string", k, e
        elif m := _CHAR.match(src, k):
            e = m.end()
        elif m := _IDENT.match(src, k):
            e = m.end()
            yield "ident", k, e
        else:
            e = k + 1
            if not c.isspace():
                yield "punct", k, e
        k = e


def _place(starts: list[int], at: int) -> tuple[int, int]:
    from bisect import bisect_right

    line = bisect_right(starts, at)
    return line, at - starts[line - 1]


def literals(src: str, doc: bool = True, dev: bool = False) -> list[dict]:
    """The literals of a source in order: doc comments and attributes, and developer comments."""
    starts = [0, *[m.end() for m in re.finditer("\n", src)]]
    tokens = list(lex(src))
    out: list[dict] = []

    def put(kind: str, tag: str, start: int, end: int, pre: int, post: int, doc_prefix: str | None = None, hashes: int = 0, first: bool = True) -> None:
        s, e = start + pre, end - post
        (l0, c0), (l1, c1) = _place(starts, s), _place(starts, max(e - 1, s) if e > s else s)
        if e <= s:  # nothing inside: the place before
            l1, c1 = l0, c0 - 1 if c0 else 0
        out.append({
            "category": kind, "variant": {"tag": tag, "doc_prefix": doc_prefix, "hashes": hashes}, "rendered": src[start:end], "pre": pre, "post": post, "text": src[s:e],
            "span": {"start": {"line": l0, "col": c0}, "end": {"line": l1, "col": c1}}, "first_of_block": first,
        })

    for k, (kind, s, e) in enumerate(tokens):
        body = src[s:e]
        if kind == "line":
            if body.startswith("///") and not body.startswith("////"):
                doc and put("Doc", "TripleSlash", s, e, 3, 0)
            elif body.startswith("//!"):
                doc and put("Doc", "DoubleSlashEM", s, e, 3, 0)
            elif dev and not body.startswith(("///", "//|")):
                put("Dev", "DoubleSlash", s, e, 2, 0)
        elif kind == "block":
            if body.startswith("/**") and not body.startswith(("/***", "/**/")):
                doc and put("Doc", "SlashAsteriskAsterisk", s, e, 3, 2)
            elif body.startswith("/*!"):
                doc and put("Doc", "SlashAsteriskEM", s, e, 3, 2)
            elif dev and len(body) >= 4:  # a literal for each line; its stars and blanks stay
                at, lines = s, body.split("\n")
                for i, line in enumerate(lines):
                    put("Dev", "SlashStar", at, at + len(line), 2 if i == 0 else 0, 2 if i == len(lines) - 1 else 0, first=i == 0)
                    at += len(line) + 1
        elif kind == "punct" and body == "#" and doc and (m := _DOC.match(src, s)):
            after = k + 1
            while after < len(tokens) and tokens[after][1] < m.end():
                after += 1
            if after == len(tokens):
                continue
            what, a, b = tokens[after]
            if what == "raw":
                n = len(_RAW.match(src, a)[1])
                put("Doc", "MacroDocEqStr", a, b, n + 2, n + 1, src[s:a], n + 1)
            elif what == "string":
                put("Doc", "MacroDocEqStr", a, b, 1, 1, src[s:a], 0)
            elif what == "ident":  # a macro: nothing to read, but the chunk goes on
                put("Doc", "MacroDocEqMacro", a, a, 0, 0)
    out.sort(key=lambda x: (x["span"]["start"]["line"], x["span"]["start"]["col"]))
    return out


def modules(src: str) -> list[str]:
    """The names that `mod NAME;` declares, at any depth."""
    code = [(src[s:e]) for kind, s, e in lex(src) if kind in ("ident", "punct")]
    return [code[k + 1] for k in range(len(code) - 2) if code[k] == "mod" and _IDENT.fullmatch(code[k + 1]) and code[k + 2] == ";"]


_SPAN = pa.struct([("start", pa.struct([("line", pa.int32()), ("col", pa.int32())])), ("end", pa.struct([("line", pa.int32()), ("col", pa.int32())]))])
_VARIANT = pa.struct([("tag", pa.string()), ("doc_prefix", pa.string()), ("hashes", pa.int32())])
_KINDS = {"lit_idx": pa.int32(), "category": pa.string(), "variant": _VARIANT, "rendered": pa.string(), "pre": pa.int32(), "post": pa.int32(), "text": pa.string(), "span": _SPAN, "first_of_block": pa.bool_()}


def extract(origins: DataFrame, doc: bool = True, dev: bool = False, id_col: str = "origin_id", content_col: str = "content") -> DataFrame:
    """Literals (schema.LITERALS and first_of_block) of Rust origins.

    A source that does not lex has one row instead, of category Error, with what is wrong as its text.
    """

    def of(src: str | None) -> Iterator[tuple]:
        try:
            found = literals(src or "", doc, dev)
        except ValueError as e:
            found = [{**dict.fromkeys(_KINDS), "category": "Error", "text": str(e)}]
        for i, x in enumerate(found):
            yield i, *(x[c] for c in _KINDS if c != "lit_idx")

    kinds = pa.schema([("origin_id", pa.string()), *_KINDS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_parts(batches, 1, of, kinds)

    from pyspark.sql import functions as F

    return origins.select(F.col(id_col).cast("string"), content_col).mapInArrow(run, f"{schema.LITERALS}, first_of_block boolean")
