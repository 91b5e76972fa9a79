"""Markdown to plain text and back, paragraphs, Rust comments, wrapping."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import cmark, reflow, rustlex, tokens

CASES = [
    ("One\n\n***\n\ne🌡🍁x\n\n___\n\nlast", "One\n\n\ne🌡🍁x\n\n\nlast", 3),
    ("before\n\n```py\nhidden = 1\n```\n\nafter", "before\n\nafter", 2),
    ("before\n\n    hidden()\n\nafter", "before\n\nafter", 2),
    ("take `Vec<T>` or `a_b`, not `::`.", "take VecT or ab, not .", 6),
    ("`abcdefghijklmnopqrstuvwxyz`", "abcdefghijklmnop", 1),
    ("see [^note1] there", "see note1 there", 3),
    ("a [link text](http://x.example/y) b", "a link text b", 3),
    ("a <http://x.example> b", "a  b", 2),
    (" <http://x.example>", "", 0),
    ("a <me@x.example> b", "a  b", 2),
    ("[words][ref]", "words", 1),
    ("[words][]", "words", 1),
    ("[words]", "words", 1),
    ("[words]: http://x.example\n\ntext", "text", 1),
    ("![alt](p.png \"the title\") z", "the titlealt z", 3),
    ("an <em>old</em> tag and <code>hidden</code> code", "an old tag and  code", 4),
    ("- one\n- two\n  - three\n", "\none\ntwo\nthree", 3),
    ("1. one\n2. two", "\none\ntwo", 2),
    ("- [ ] open\n- [x] done", "\nopen\ndone", 2),
    ("top\n\n|h|i|\n|-|-|\n|j|k|\n\nend", "top\n\n\nend", 2),
    ("<div>\nhidden\n</div>\n\nshown", "shown", 1),
    ("# Head #\n\nText\n\nLower\n-----\n\nmore", "Head\n\nText\n\nLower\n\nmore", 4),
    ("*a* **b** ***c*** _d_ __e__ ~f~ ~~g~~ snake_case_word 2 * 3", "a b c d e f g snake_case_word 2 * 3", 14),
    ("hard  \nbreak\\\nagain\nsoft", "hard\n\nbreak\n\nagain\nsoft", 4),
    ("\\*no\\* &amp; yes", "*no* & yes", 4),
    ("> quoted\n> more\n\nout", "quoted\nmore\n\nout", 3),
    ("cost $x + y$ here", "cost  here", 2),
    ("", "", 0),
    ("\n\n", "", 0),
]


@pytest.mark.parametrize(("text", "plain", "n"), CASES)
def test_erasure(text, plain, n):
    got, maps = cmark.erase(text)
    assert got == plain
    assert len(maps) == n
    for (s, e), (a, b), alias in maps:
        if alias is None and "&" not in text[a:b] and "![" not in text[a:b]:
            assert got[s:e] == text[a:b]


def test_footnotes_can_be_left_out():
    assert cmark.erase("see [^note1] there", ignore_footnotes=True)[0] == "see  there"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["*", "_", "**", "`", "[", "]", "(x)", "<b>", "\n", "\n\n", "# ", "- ", "> ", "|", "a", "word ", "~", "\\", "&lt;", "    ", "```", "🙂", "![", "1. ", "<", "---\n"]), max_size=40))
def test_any_text_maps_back(parts):
    text = "".join(parts)
    plain, maps = cmark.erase(text)
    last = 0
    for (s, e), (a, b), alias in maps:
        assert last <= s < e <= len(plain) and 0 <= a <= b <= len(text)
        last = e
        if alias is None and "&" not in text[a:b] and "![" not in text[a:b]:
            assert plain[s:e] == text[a:b]
    assert not plain.endswith("\n")
    for s, e, held in cmark.paragraphs(text):
        assert 0 <= s < e <= len(text) and all(s <= a <= b <= e for a, b in held)


TOKENS = [
    ("isn't", ["isn't"]), ("ink!'s", ["ink!'s"]), ("(ink!'s)", ["(", "ink!'s", ")"]), ("Foo.", ["Foo", "."]), ("[1337]", ["[", "1337", "]"]),
    ("(Xyz's)", ["(", "Xyz's", ")"]), ("x🌡 y", ["x🌡", "y"]), ("🌡🍁", ["🌡🍁"]), ("a b", ["a", "b"]), ("", []),
]


@pytest.mark.parametrize(("text", "want"), TOKENS)
def test_tokens(text, want):
    assert [text[s:e] for s, e in tokens.tokenize(text)] == want


@given(st.text("ab'\"() .🙂é1_", max_size=30))
def test_tokens_are_apart_and_in_order(text):
    last = 0
    for s, e in tokens.tokenize(text):
        assert last <= s < e <= len(text)
        last = e


SOURCES = [
    ("/// one\n/// two\nfn f() {}", [("TripleSlash", " one"), ("TripleSlash", " two")]),
    ("//! inner\n", [("DoubleSlashEM", " inner")]),
    ("/** block */", [("SlashAsteriskAsterisk", " block ")]),
    ("/*! block */", [("SlashAsteriskEM", " block ")]),
    ("#[doc = \"plain\"]", [("MacroDocEqStr", "plain")]),
    ("#[doc=r#\"raw \"x\" \"#]", [("MacroDocEqStr", "raw \"x\" ")]),
    ("#[doc = m!(a)]\nstruct X;", [("MacroDocEqMacro", "")]),
    ("let s = \"/// no\"; let c = '\"'; // dev\nlet l: &'a str = r\"// no\";", [("DoubleSlash", " dev")]),
    ("//// four\n//| bar\n//", [("DoubleSlash", "")]),
    ("/* one\n * two */", [("SlashStar", " one"), ("SlashStar", " * two ")]),
    ("/* a /* nested */ b */ fn x() {}", [("SlashStar", " a /* nested */ b ")]),
    ("/**/ /***/", [("SlashStar", ""), ("SlashStar", "*")]),
]


@pytest.mark.parametrize(("src", "want"), SOURCES)
def test_literals(src, want):
    found = rustlex.literals(src, True, True)
    assert [(x["variant"]["tag"], x["text"]) for x in found] == want
    lines = src.split("\n")
    for x in found:
        s, e = x["span"]["start"], x["span"]["end"]
        if x["text"] and s["line"] == e["line"]:
            assert lines[s["line"] - 1][s["col"] : e["col"] + 1] == x["text"]


def test_unclosed_sources_do_not_lex():
    for bad in ("/* a", 'let x = "a', 'let x = r#"a"'):
        with pytest.raises(ValueError):
            list(rustlex.lex(bad))


def test_modules():
    assert rustlex.modules("mod a; pub mod b { mod c; } // mod d;\n/* mod e; */ mod f {} let x = \"mod g;\";") == ["a", "c"]


@given(st.lists(st.text("abcdefgh", min_size=1, max_size=12), max_size=30), st.integers(5, 30))
def test_filled_lines_keep_words_and_width(words, width):
    lines = reflow.fill(words, width)
    assert " ".join(lines).split() == words
    assert all(len(x) <= width or " " not in x for x in lines)
    assert reflow.fill(" ".join(lines).split(), width) == lines


def test_lines_use_the_next_indentation():
    assert reflow.fill("aaa bbb ccc ddd".split(), 9, [0, 0, 4]) == ["aaa bbb", "ccc", "ddd"]


def test_reflow():
    text = "These words are more than thirty columns wide,\nso they move."
    (s, e, new), = reflow.reflow_text(text, 30)
    assert (s, e) == (0, len(text)) and new == "These words are more than\nthirty columns wide, so they\nmove."
    assert reflow.reflow_text("short", 30) == []
    (_, _, new), = reflow.reflow_text("aaaa [bbbb cccc](x) dddd `eeee ffff` gggg", 20)
    assert new == "aaaa [bbbb cccc](x)\ndddd `eeee ffff`\ngggg"
    (_, _, new), = reflow.reflow_text("one two three four five", 16, prefix="///", indents=[0])
    assert new == "one two\n/// three four\n/// five"
    assert reflow.reflow_text("> a long quote stays as it is, however wide it may be", 20) == []
