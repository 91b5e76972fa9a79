"""Markdown to events with exact offsets, and what is made of them: plain text with a map back, and paragraphs to wrap.

Blocks: headings of both kinds, rules, fenced and indented code, HTML, quotes, lists with task marks, tables, link
definitions, paragraphs. Inlines: code, emphasis, strong, strikethrough, links and images of all kinds, autolinks,
footnote references, HTML, math, breaks, escapes. Links need no definition.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from .batches import in_parts

Line = tuple[int, str]


@dataclass
class Event:
    kind: str  # text, code, html, soft, hard, rule, footnote, math, task; start and end of tags
    start: int
    end: int
    text: str = ""
    tag: str = ""


_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_ITEM = re.compile(r"( {0,3})([*+-]|\d{1,9}[.)])( +|\t|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_HTML = re.compile(r" {0,3}<(?:!--|[?!]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_HTML_ALONE = re.compile(r" {0,3}(?:<[A-Za-z][^<>]*>|</[A-Za-z][^<>]*>)\s*$")
_BLOCK_TAGS = re.compile(
    r" {0,3}(?:<!--|<\?|<![A-Z]|</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|pre|script|search|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|track|ul)(?:[\s/>]|$))",
    re.I,
)
_DEFINITION = re.compile(r" {0,3}\[(?!\^)[^\]\n]+\]:\s*\S+")
_FOOTNOTE_DEFINITION = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
_DELIMITER_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")


def _lines(text: str) -> list[Line]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line) + 1
    return out


def _indent(s: str) -> int:
    return len(s) - len(s.lstrip(" "))


class _Blocks:
    def __init__(self) -> None:
        self.events: list[Event] = []

    def put(self, kind: str, start: int, end: int, text: str = "", tag: str = "") -> None:
        self.events.append(Event(kind, start, end, text, tag))

    def interrupts(self, s: str) -> bool:
        """Whether a line ends the paragraph before it."""
        item = _ITEM.match(s)
        return bool(_RULE.match(s) or _HEADING.match(s) or _FENCE.match(s) or _QUOTE.match(s) or _BLOCK_TAGS.match(s) or (item and s[item.end() :].strip() and (item[2] in "*+-" or item[2][:-1] == "1")))

    def run(self, lines: list[Line], tight: bool = False) -> None:
        k = 0
        while k < len(lines):
            at, s = lines[k]
            if not s.strip():
                k += 1
                continue
            if _indent(s) >= 4:
                j = k
                while j < len(lines) and (_indent(lines[j][1]) >= 4 or not lines[j][1].strip()):
                    j += 1
                self.verbatim(lines[k:j], "code_block")
                k = j
            elif _RULE.match(s):
                self.put("rule", at, at + len(s))
                k += 1
            elif m := _HEADING.match(s):
                body = s[m.end() :].rstrip()
                body = re.sub(r"(?:^|[ \t]+)#+$", "", body)
                self.put("start", at, at + len(s), tag="heading")
                self.inlines([(at + m.end(), body)])
                self.put("end", at, at + len(s), tag="heading")
                k += 1
            elif (m := _FENCE.match(s)) and not (m[1][0] == "`" and "`" in m[2]):
                j = k + 1
                close = re.compile(r" {0,3}%s{%d,}[ \t]*$" % (re.escape(m[1][0]), len(m[1])))
                while j < len(lines) and not close.match(lines[j][1]):
                    j += 1
                self.verbatim(lines[k + 1 : j], "code_block")
                k = j + 1
            elif _QUOTE.match(s):
                inner = []
                while k < len(lines) and ((m := _QUOTE.match(lines[k][1])) or (inner and inner[-1][1].strip() and lines[k][1].strip() and not self.interrupts(lines[k][1]))):
                    cut = m.end() if m else 0
                    inner.append((lines[k][0] + cut, lines[k][1][cut:]))
                    k += 1
                self.put("start", at, inner[-1][0], tag="quote")
                self.run(inner)
                self.put("end", at, inner[-1][0] + len(inner[-1][1]), tag="quote")
            elif m := _ITEM.match(s):
                k = self.list(lines, k, m)
            elif _BLOCK_TAGS.match(s) or _HTML_ALONE.match(s):
                j = k
                until = re.compile("-->") if s.lstrip().startswith("<!--") else None
                while j < len(lines) and (until or lines[j][1].strip()):
                    j += 1
                    if until and until.search(lines[j - 1][1]):
                        break
                self.put("start", at, at, tag="html_block")
                for a, t in lines[k:j]:
                    self.put("html", a, a + len(t), t)
                self.put("end", at, lines[j - 1][0] + len(lines[j - 1][1]), tag="html_block")
                k = j
            elif m := _FOOTNOTE_DEFINITION.match(s):
                j = k + 1
                while j < len(lines) and lines[j][1].strip() and not self.interrupts(lines[j][1]):
                    j += 1
                self.put("start", at, at, tag="footnote")
                self.run([(at + m.end(), s[m.end() :]), *lines[k + 1 : j]])
                self.put("end", at, at, tag="footnote")
                k = j
            elif _DEFINITION.match(s):
                k += 1
            elif "|" in s and k + 1 < len(lines) and "-" in lines[k + 1][1] and _DELIMITER_ROW.match(lines[k + 1][1]) and ("|" in lines[k + 1][1]) and self.cells(s) == self.cells(lines[k + 1][1]):
                j = k
                while j < len(lines) and lines[j][1].strip() and (j < k + 2 or not self.interrupts(lines[j][1])):
                    j += 1
                self.put("start", at, lines[j - 1][0] + len(lines[j - 1][1]), tag="table")
                for n, (a, t) in enumerate(lines[k:j]):
                    if n != 1:
                        self.inlines([(a, t)])
                self.put("end", at, lines[j - 1][0] + len(lines[j - 1][1]), tag="table")
                k = j
            else:
                j = k + 1
                heading = False
                while j < len(lines) and lines[j][1].strip():
                    if _SETEXT.match(lines[j][1]):
                        heading = True
                        break
                    if self.interrupts(lines[j][1]):
                        break
                    j += 1
                body = [(a + _indent(t), t.lstrip(" ")) for a, t in lines[k:j]]
                a, t = body[-1]
                body[-1] = (a, t.rstrip())
                end = a + len(body[-1][1])
                tag = "heading" if heading else "tight" if tight else "paragraph"
                self.put("start", body[0][0], end, tag=tag)
                self.inlines(body)
                self.put("end", body[0][0], end, tag=tag)
                k = j + heading

    @staticmethod
    def cells(s: str) -> int:
        return len(re.sub(r"\\\|", "", s.strip().strip("|")).split("|"))

    def verbatim(self, lines: list[Line], tag: str) -> None:
        at = lines[0][0] if lines else 0
        self.put("start", at, at, tag=tag)
        for a, t in lines:
            self.put("text", a, a + len(t), t)
        self.put("end", at, at, tag=tag)

    def list(self, lines: list[Line], k: int, first: re.Match) -> int:
        ordered, mark = first[2][-1] in ".)", first[2][-1]
        items: list[list[Line]] = []
        loose = False
        while k < len(lines):
            m = _ITEM.match(lines[k][1])
            if not m or m[2][-1] != mark or (m[2][-1] in ".)") != ordered or _RULE.match(lines[k][1]):
                break
            width = len(m[1]) + len(m[2]) + (len(m[3]) if 1 <= len(m[3]) <= 4 and m[3] != "\t" else 1)
            at, s = lines[k]
            item = [(at + width, s[width:])]
            k += 1
            while k < len(lines):
                a, t = lines[k]
                if not t.strip():
                    nxt = next((x for x in lines[k + 1 :] if x[1].strip()), None)
                    if nxt is None or (_indent(nxt[1]) < width and not (_ITEM.match(nxt[1]) and _ITEM.match(nxt[1])[2][-1] == mark)):
                        break
                    loose = loose or _indent(nxt[1]) < width or _indent(nxt[1]) == width
                    item.append((a, ""))
                elif _indent(t) >= width:
                    item.append((a + width, t[width:]))
                elif item[-1][1].strip() and not _ITEM.match(t) and not self.interrupts(t):
                    item.append((a + _indent(t), t.lstrip(" ")))
                else:
                    break
                k += 1
            items.append(item)
            if k < len(lines) and not lines[k][1].strip():
                break
        self.put("start", items[0][0][0], items[-1][-1][0], tag="list")
        for item in items:
            self.put("start", item[0][0], item[-1][0], tag="item")
            a, t = item[0]
            if task := re.match(r"\[[ xX]\][ \t]+", t):
                self.put("task", a, a + 3)
                item[0] = (a + task.end(), t[task.end() :])
            self.run(item, tight=not loose)
            self.put("end", item[0][0], item[-1][0] + len(item[-1][1]), tag="item")
        self.put("end", items[0][0][0], items[-1][-1][0], tag="list")
        return k

    def inlines(self, lines: list[Line]) -> None:
        """Inline events of a block; lines keep their own offsets."""
        text = "\n".join(t for _, t in lines)
        at: list[int] = []
        for a, t in lines:
            at += range(a, a + len(t) + 1)
        if not text:
            return
        at.append(at[-1] + 1)
        self.events += _Inlines(text, at).run()


_CODE = re.compile(r"`+")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|<!--.*?-->|<\?.*?\?>|<![A-Z].*?>", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_MATH = re.compile(r"(\$\$?)(?! )([^$]+?)(?<! )\1")
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class _Inlines:
    def __init__(self, text: str, at: list[int]) -> None:
        self.t, self.at = text, at
        self.out: list[Event] = []
        self.delimiters: list[dict] = []
        self.brackets: list[dict] = []

    def put(self, kind: str, s: int, e: int, text: str = "", tag: str = "") -> None:
        self.out.append(Event(kind, self.at[s], self.at[e - 1] + 1 if e > s else self.at[s], text, tag))

    def text(self, s: int, e: int) -> None:
        if e > s:
            last = self.out[-1] if self.out else None
            if last is not None and last.kind == "text" and last.end == self.at[s] and last.tag == "" and not last.text.endswith("\n"):
                last.text += self.t[s:e]
                last.end = self.at[e - 1] + 1
            else:
                self.put("text", s, e, self.t[s:e])

    def run(self) -> list[Event]:
        t, k, n = self.t, 0, len(self.t)
        while k < n:
            c = t[k]
            if c == "\\" and k + 1 < n and t[k + 1] in _PUNCTUATION:
                self.put("text", k + 1, k + 2, t[k + 1])
                k += 2
            elif c == "\\" and k + 1 < n and t[k + 1] == "\n":
                self.put("hard", k, k + 2)
                k += 2
            elif c == "\n":
                end = k
                while end > 0 and t[end - 1] == " ":
                    end -= 1
                blank = k - end
                if blank and self.out and self.out[-1].kind == "text":
                    self.out[-1].text = self.out[-1].text.rstrip(" ")
                    self.out[-1].end -= blank
                    if not self.out[-1].text:
                        self.out.pop()
                self.put("hard" if blank >= 2 else "soft", k, k + 1)
                k += 1
            elif c == "`":
                run = _CODE.match(t, k)[0]
                close = next((m for m in _CODE.finditer(t, k + len(run)) if m[0] == run), None)
                if close:
                    inner = t[k + len(run) : close.start()].replace("\n", " ")
                    if len(inner) > 2 and inner[0] == inner[-1] == " " and inner.strip():
                        inner = inner[1:-1]
                    self.put("code", k, close.end(), inner)
                    k = close.end()
                else:
                    self.text(k, k + len(run))
                    k += len(run)
            elif c == "$" and (m := _MATH.match(t, k)):
                self.put("math", k, m.end(), m[2])
                k = m.end()
            elif c == "<" and (m := _AUTO.match(t, k)):
                self.put("start", k, m.end(), tag="autolink")
                self.out.append(Event("text", self.at[k + 1], self.at[m.end() - 1], m[1], "auto"))
                self.put("end", k, m.end(), tag="autolink")
                k = m.end()
            elif c == "<" and (m := _TAG.match(t, k)):
                self.put("html", k, m.end(), m[0])
                k = m.end()
            elif c == "&" and (m := _ENTITY.match(t, k)) and html.unescape(m[0]) != m[0]:
                self.out.append(Event("text", self.at[k], self.at[m.end() - 1] + 1, html.unescape(m[0]), "entity"))
                k = m.end()
            elif c in "*_~":
                k = self.delimiter(k)
            elif c == "[" and (m := re.compile(r"\[\^([^\]\s]+)\]").match(t, k)):
                self.put("footnote", k, m.end(), m[1])
                k = m.end()
            elif c == "[" or (c == "!" and t[k + 1 : k + 2] == "["):
                size = 2 if c == "!" else 1
                self.brackets.append({"at": len(self.out), "from": k, "image": size == 2, "inner": k + size, "open": len(self.delimiters), "on": True})
                self.put("text", k, k + size, t[k : k + size], tag="mark")
                k += size
            elif c == "]":
                k = self.close(k)
            else:
                j = k + 1
                while j < n and t[j] not in "\\\n`$<&*_~[]!":
                    j += 1
                self.text(k, j)
                k = j
        self.emphasis(0)
        return [e for e in self.out if not (e.kind == "text" and e.text == "")]

    def delimiter(self, k: int) -> int:
        t, c = self.t, self.t[k]
        e = k
        while e < len(t) and t[e] == c:
            e += 1
        before, after = t[k - 1] if k else " ", t[e] if e < len(t) else " "
        mark = lambda x: not x.isalnum() and not x.isspace()
        left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
        right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
        opens, closes = left, right
        if c == "_":
            opens, closes = left and (not right or mark(before)), right and (not left or mark(after))
        if c == "~" and e - k > 2:
            opens = closes = False
        self.delimiters.append({"at": len(self.out), "c": c, "n": e - k, "s": k, "opens": opens, "closes": closes})
        self.put("text", k, e, t[k:e], tag="mark")
        return e

    def close(self, k: int) -> int:
        t = self.t
        if not self.brackets:
            self.text(k, k + 1)
            return k + 1
        b = self.brackets.pop()
        if not b["on"]:
            self.text(k, k + 1)
            return k + 1
        end, title = k + 1, ""
        if m := _TARGET.match(t, k + 1):
            end, title = m.end(), (m[1] or "  ")[1:-1]
        elif m := re.compile(r"\[[^\[\]]*\]").match(t, k + 1):
            end = m.end()
        elif not t[b["inner"] : k].strip():
            self.text(k, k + 1)
            return k + 1
        tag = "image" if b["image"] else "link"
        self.emphasis(b["open"])
        self.out[b["at"]] = Event("start", self.at[b["from"]], self.at[end - 1] + 1, title.strip() if b["image"] else "", tag)
        self.put("end", b["from"], end, tag=tag)
        if not b["image"]:
            for x in self.brackets:
                x["on"] = x["on"] and x["image"]
        return end

    def emphasis(self, bottom: int) -> None:
        """Pairs delimiters from bottom on; pairs become start and end events in place of their marks."""
        stack = self.delimiters[bottom:]
        del self.delimiters[bottom:]
        before: dict[int, list[Event]] = {}
        after: dict[int, list[Event]] = {}
        k = 0
        while k < len(stack):
            d = stack[k]
            j = k - 1
            if d["closes"] and d["n"]:
                while j >= 0:
                    o = stack[j]
                    thirds = (o["closes"] or d["opens"]) and (o["n"] + d["n"]) % 3 == 0 and not (o["n"] % 3 == 0 and d["n"] % 3 == 0)
                    if o["opens"] and o["n"] and o["c"] == d["c"] and (o["n"] == d["n"] if d["c"] == "~" else not thirds):
                        break
                    j -= 1
                if j >= 0:
                    o = stack[j]
                    n = d["n"] if d["c"] == "~" else 2 if min(o["n"], d["n"]) >= 2 else 1
                    tag = "strike" if d["c"] == "~" else "strong" if n == 2 else "emphasis"
                    s, e = o["s"] + o["n"] - n, d["s"] + n
                    after.setdefault(o["at"], []).insert(0, Event("start", self.at[s], self.at[e - 1] + 1, "", tag))
                    before.setdefault(d["at"], []).append(Event("end", self.at[s], self.at[e - 1] + 1, "", tag))
                    o["n"] -= n
                    d["n"] -= n
                    d["s"] += n
                    for x in stack[j + 1 : k]:
                        x["n_left"], x["opens"], x["closes"] = x["n"], False, False
                    if d["n"]:
                        continue
            k += 1
        if not before and not after:
            return
        lowest = min(d["at"] for d in stack)
        out = self.out[:lowest]
        marks = {d["at"]: d for d in stack}
        for i in range(lowest, len(self.out)):
            e = self.out[i]
            if i in marks:
                d = marks[i]
                out += before.get(i, [])
                if d["n"]:
                    out.append(Event("text", self.at[d["s"]], self.at[d["s"] + d["n"] - 1] + 1, d["c"] * d["n"], ""))
                out += after.get(i, [])
            else:
                out.append(e)
        self.out = out


def events(text: str) -> list[Event]:
    blocks = _Blocks()
    blocks.run(_lines(text))
    out: list[Event] = []
    for e in blocks.events:  # neighbouring texts are one
        if e.kind == "text" and out and out[-1].kind == "text" and out[-1].end == e.start and e.tag in ("", "mark") and out[-1].tag in ("", "mark"):
            out[-1] = Event("text", out[-1].start, e.end, out[-1].text + e.text, "")
        else:
            out.append(e)
    return out


Mapped = tuple[tuple[int, int], tuple[int, int], "str | None"]


def erase(text: str, ignore_footnotes: bool = False) -> tuple[str, list[Mapped]]:
    """(plain text, [(range there, range in text, alias or None)])."""
    plain: list[str] = []
    size = 0
    maps: list[Mapped] = []

    def put(s: str, start: int, end: int, alias: str | None = None) -> None:
        nonlocal size
        plain.append(s)
        maps.append(((size, size + len(s)), (start, end), alias))
        size += len(s)

    def newlines(n: int) -> None:
        nonlocal size
        plain.append("\n" * n)
        size += n

    quiet = code = 0
    table = skip = False
    for e in events(text):
        if e.kind == "start":
            quiet += e.tag in ("html_block", "code_block")
            table = table or e.tag == "table"
            skip = skip or e.tag == "autolink"
            if e.tag == "list":
                newlines(1)
            elif e.tag == "image" and e.text:
                put(e.text, e.start, e.end)
        elif e.kind == "end":
            quiet -= e.tag in ("html_block", "code_block")
            if e.tag == "table":
                table = False
            newlines({"table": 1, "item": 1, "heading": 2, "paragraph": 2}.get(e.tag, 0))
        elif e.kind == "text":
            if quiet or code:
                continue
            if skip:
                skip = False
            elif not table:
                put(e.text, e.start, e.end)
        elif e.kind == "code":
            alias = "".join(c for c in e.text if c.isascii() and c.isalnum())[:16]
            if alias:
                put(alias, e.start, e.end, alias)
        elif e.kind == "html":
            if not quiet and re.match(r"<code[\s>]", e.text, re.I):
                code += 1
            elif not quiet and re.match(r"</code\s*>", e.text, re.I):
                code = max(0, code - 1)
        elif e.kind == "footnote":
            if not ignore_footnotes:
                put(e.text, e.start + 2, e.end - 1)
        elif e.kind in ("soft", "hard", "rule"):
            newlines(2 if e.kind == "hard" else 1)
    out = "".join(plain)
    kept = len(out.rstrip("\n"))
    clipped = []
    for p, r, alias in maps:
        if p[1] > kept and p[0] < kept:
            r = r if alias else (r[0], r[1] - (p[1] - kept))
            p = (p[0], kept)
        if p[0] < kept:
            clipped.append((p, r, alias))
    return out[:kept], clipped


_UNBREAKABLE = ("image", "link", "autolink", "strong", "emphasis", "strike", "quote", "table")


def paragraphs(text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, unbreakable ranges) of the paragraphs to wrap; a hard break ends one, block quotes stay as they are."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    start: int | None = None
    held: list[tuple[int, int]] = []
    quotes = depth = 0
    for e in events(text):
        if e.tag == "quote":
            quotes += 1 if e.kind == "start" else -1
        if quotes:
            start = None
        elif e.kind == "start" and e.tag in ("paragraph", "tight"):
            start, held, depth = e.start, [], 0
        elif e.kind == "end" and e.tag in ("paragraph", "tight"):
            if start is not None and e.end > start:
                out.append((start, e.end, held))
            start = None
        elif start is None:
            continue
        elif e.kind == "hard":
            if e.start > start:
                out.append((start, e.start, held))
            start, held = e.end, []
        elif e.kind == "start" and e.tag in _UNBREAKABLE:
            if depth == 0:
                held.append((e.start, e.end))
            depth += 1
        elif e.kind == "end" and e.tag in _UNBREAKABLE:
            depth -= 1
        elif e.kind in ("code", "html", "footnote", "math") and depth == 0:
            held.append((e.start, e.end))
    return out


def plain_chunks(chunks: DataFrame, keys: tuple[str, ...] = ("origin_id", "chunk_idx"), text_col: str = "text", ignore_footnotes: bool = False) -> DataFrame:
    """keys, plain and plain_map for each row, batch by batch."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*keys).schema.fields)
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kind = pa.list_(pa.struct([("p", pair), ("r", pair), ("alias", pa.string())]))

    kinds = pa.schema([*to_arrow_schema(chunks.select(*keys).schema), ("plain", pa.string()), ("plain_map", kind)])

    def of(text: str | None) -> Iterator[tuple]:
        plain, m = erase(text or "", ignore_footnotes)
        yield plain, [{"p": {"start": p[0], "end": p[1]}, "r": {"start": r[0], "end": r[1]}, "alias": a} for p, r, a in m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_parts(batches, len(keys), of, kinds)

    return chunks.select(*keys, text_col).mapInArrow(run, f"{own}, plain string, plain_map array<struct<p:{schema.RANGE},r:{schema.RANGE},alias:string>>")


def to_source(plain_map, start, end):
    """The range of the text that a plain range stands for, as struct(start, end): through the entry that contains its start; null inside an alias."""
    from pyspark.sql import functions as F

    own = F.get(F.filter(plain_map, lambda m: (m["p"]["start"] <= start) & (start < m["p"]["end"]) & m["alias"].isNull()), F.lit(0))
    shift = own["r"]["start"] - own["p"]["start"]
    return F.when(own.isNotNull(), F.struct((start + shift).alias("start"), F.least(end + shift, own["r"]["end"]).alias("end")))
