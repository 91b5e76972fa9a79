"""Positions, words, lexicons, findings, patches, reports, settings, projects, actions and streams."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import comments, positions
from quillspark.functions import words as W
from quillspark.operators import chunks, cmark, findings, grammar, lexicon, patch, reflow, report, rustlex, spell
from quillspark.plans import api, config
from quillspark.sources import project, readers
from quillspark.streaming import incremental

from .conftest import SF


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def span(l0, c0, l1, c1):
    return positions.span(*map(F.lit, (l0, c0, l1, c1)))


DELIMITERS = [("a\nb\nc", "\n"), ("a\rb\rc", "\r"), ("a\r\nb\r\n", "\r\n"), ("a\n\rb\n\r", "\n\r"), ("plain", None), ("", None), ("a\r\nb\nc\n", "\n"), ("a\rb\nc", "\r"), ("a\nb\rc", "\n")]


@pytest.mark.parametrize(("text", "want"), DELIMITERS)
def test_dominant_delimiter(spark, text, want):
    assert one(spark, d=positions.dominant_delimiter(F.lit(text))).d == want


def test_sub_chars_counts_code_points(spark):
    s = lambda a, b: positions.sub_chars(F.lit("a🌡🍁b"), F.lit(a), F.lit(b))
    assert tuple(one(spark, a=s(1, 3), b=s(3, 9), c=s(4, 5), d=s(2, 2), e=s(-1, 2))) == ("🌡🍁", "b", "", "", "")


def test_spans_and_ranges(spark):
    r = one(
        spark, n=positions.one_line_len(span(2, 3, 2, 7)), m=positions.one_line_len(span(2, 3, 3, 7)), r=positions.span_to_range(span(2, 3, 2, 7)), s=positions.range_to_span(F.lit(4), F.lit(1), F.lit(3)),
        e=positions.range_to_span(F.lit(4), F.lit(3), F.lit(3)), i=positions.relative_to(span(2, 5, 2, 6), span(2, 3, 2, 9)), o=positions.relative_to(span(2, 5, 2, 12), span(2, 3, 2, 9)),
        c=positions.covers_line(span(2, 0, 4, 0), F.lit(3)), x=positions.covers_line(span(2, 0, 4, 0), F.lit(5)),
    )
    assert (r.n, r.m, tuple(r.r), r.e, tuple(r.i), r.o, r.c, r.x) == (5, None, (3, 8), None, (2, 4), None, True, False)
    assert (tuple(r.s.start), tuple(r.s.end)) == ((4, 1), (4, 2))


def test_trimmed_spans(spark):
    t = lambda s, a, b: comments.trim_span(s, F.lit(a), F.lit(b))
    r = one(spark, a=t(span(1, 4, 1, 20), 3, 0), b=t(span(1, 0, 1, 9), 3, 2), c=t(span(1, 0, 2, 1), 3, 2))
    assert tuple(r.a.start) == (1, 7) and tuple(r.b.end) == (1, 7) and tuple(r.c.end) == (1, 0)


EMOJIS = [("🍁", True), ("🌡🍁", True), ("a🍁", False), ("1", True), ("12", True), ("#", True), ("½", True), ("x½y", True), ("word", False), ("a-b", False), ("", False)]


@pytest.mark.parametrize(("word", "ok"), EMOJIS)
def test_emoji_words(spark, word, ok):
    assert one(spark, x=W.is_emoji(F.lit(word))).x is ok


def test_dash_quirks(spark):
    r = F.array(F.lit("multi-word"), F.lit("other"))
    c = lambda w, x: W.is_concatenation(F.lit(w), F.array(*map(F.lit, x)))
    got = one(spark, a=W.is_dashed_elsewhere(F.lit("multiword"), r), b=W.is_dashed_elsewhere(F.lit("multi-word"), r), c=W.is_dashed_elsewhere(F.lit("oultiword"), r), d=c("out-side", ["outside"]), e=c("outside", ["outside"]), f=c("out-side", ["inside"]))
    assert tuple(got) == (True, False, False, True, False, False)


ORDINALS = [("10th", True), ("11th", True), ("111th", True), ("21st", True), ("22nd", True), ("123rd", True), ("4th", True), ("1st", True), ("11st", False), ("12nd", False), ("3th", False), ("th", False)]


@pytest.mark.parametrize(("word", "ok"), ORDINALS)
def test_ordinals(spark, word, ok):
    assert one(spark, x=W.is_ordinal(F.lit(word))).x is ok


def test_transforms():
    assert W.transform("2xLabel", [r"^[0-9]+x(\w+)$"]) == ("fragments", [(2, 7, "Label")])
    assert W.transform("123", ["^[0-9]+$"]) == ("whitelisted", [])
    assert W.transform("word", ["^[0-9]+$"]) == ("atomic", [(0, 4, "word")])
    assert W.transform("a1b1c", [r"^(\w+)1(\w)$", r"^(\w)1(\w)$"]) == ("fragments", [(0, 1, "a"), (2, 3, "b"), (4, 5, "c")])
    assert W.transform("same", ["^(same)$"])[1] == [(0, 4, "same")]
    assert W.transform("word", ["(", "^word$"])[0] == "atomic"


DICTIONARIES = [("2\none\ntwo", True), ("one\ntwo", False), ("2\n3\none", False), ("+7\na\n", True), ("", False), ("1\n" + "w\n" * 10 + "5", True)]


@pytest.mark.parametrize(("content", "ok"), DICTIONARIES)
def test_dictionaries(spark, content, ok):
    assert one(spark, x=W.is_dictionary(F.lit(content))).x is ok


AFF = "PFX A Y 1\nPFX A 0 re .\nSFX D Y 2\nSFX D 0 d e\nSFX D 0 ed [^e]\nSFX S N 1\nSFX S 0 s .\nREP 2\nREP f ph\nREP a_b ab\n"


def test_affixes(spark):
    rules = lexicon.read_affixes(AFF)
    assert rules[0] == ("PFX", "A", True, "", "re", "") and rules[-1] == ("SFX", "S", False, "", "s", "") and lexicon.read_replacements(AFF) == [("f", "ph"), ("a b", "ab")]
    stems = lexicon.read_words(spark.createDataFrame([("3",), ("like/ADS",), ("walk/D",), ("plain",)], "value string"))
    got = {r.form for r in lexicon.expand(stems, lexicon.affix_table(spark, rules)).collect()}
    assert got == {"like", "liked", "likes", "relike", "reliked", "walk", "walked", "plain"}  # S does not cross with A
    extra = spark.createDataFrame([("plain",), ("new",)], "form string")
    assert lexicon.with_extra(spark.createDataFrame([(x,) for x in got], "form string"), extra).count() == len(got) + 1


def test_case_of_known_words(spark):
    forms = spark.createDataFrame([("word",), ("Paris",), ("USA",)], "form string")
    words = spark.createDataFrame([(w,) for w in ("word", "Word", "WORD", "wOrd", "paris", "Paris", "PARIS", "usa", "USA", "1st")], "word string")
    assert {r.word for r in spell.unknown(words, forms).collect()} == {"wOrd", "paris", "usa"}


def test_candidates_are_those_of_all_pairs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abc", k=r.randint(1, 7)))
    unknown, forms = sorted({word() for _ in range(60)}), sorted({word() for _ in range(80)})
    u, f = spark.createDataFrame([(x,) for x in unknown], "word string"), spark.createDataFrame([(x,) for x in forms], "form string")
    pairs = u.crossJoin(f).withColumn("distance", F.levenshtein("word", "form")).filter(F.col("distance").between(1, 2))
    want = {}
    for p in pairs.collect():
        want.setdefault(p.word, []).append((p.distance, p.form))
    got = {}
    for p in spell.candidates(u, f).collect():
        got.setdefault(p.word, []).append((p.distance, p.form))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


OVERLAPS = [((1, 0, 1, 5), (1, 3, 1, 8), True), ((1, 0, 1, 3), (1, 3, 1, 8), False), ((1, 0, 1, 5), (2, 0, 2, 5), False), ((1, 4, 1, 4), (1, 4, 1, 4), False), ((1, 0, 1, 9), (1, 2, 1, 3), True), ((1, 3, 1, 8), (1, 0, 1, 5), True), ((1, 5, 2, 3), (2, 1, 2, 4), True)]


@pytest.mark.parametrize(("a", "b", "want"), OVERLAPS)
def test_overlap(spark, a, b, want):
    side = lambda x: dict(zip(findings.PLACE, map(F.lit, x), strict=True))
    assert one(spark, x=findings.overlaps(side(a), side(b))).x is want


def test_overlap_looks_at_the_finding_before_kept_or_not(spark):
    rows = [("o", "hunspell", 1, 0, 1, 5), ("o", "hunspell", 1, 3, 1, 8), ("o", "hunspell", 1, 7, 1, 12), ("o", "hunspell", 1, 20, 1, 22), ("p", "hunspell", 1, 3, 1, 8)]
    df = spark.createDataFrame(rows, "origin_id string, detector string, start_line int, start_col int, end_line int, end_col int").withColumn("replacements", F.array().cast("array<string>"))
    kept = sorted((r.origin_id, r.start_col) for r in findings.without_overlaps(findings.union(df, df)).collect())
    assert kept == [("o", 0), ("o", 20), ("p", 3)]
    assert findings.verdict(df).first().asDict() == {"n_findings": 5, "mistakes": True, "exit_code": 1}
    assert findings.verdict(df.filter("false")).first().asDict() == {"n_findings": 0, "mistakes": False, "exit_code": 0}


PATCHES = [("abcdef", [], "abcdef"), ("abcdef", [(1, 3, "X")], "aXdef"), ("abcdef", [(0, 0, "<"), (6, 6, ">")], "<abcdef>"), ("abcdef", [(0, 2, ""), (2, 4, "yy"), (4, 4, "-")], "yy-ef"), ("a🌡🍁b", [(1, 2, "x")], "ax🍁b"), ("", [(0, 0, "new")], "new"), ("a\nb", [(1, 2, " ")], "a b")]


@pytest.mark.parametrize(("text", "patches", "want"), PATCHES)
def test_patches(spark, text, patches, want):
    texts = spark.createDataFrame([(1, text), (2, "other")], "doc_id long, text string")
    p = spark.createDataFrame([(1, *x) for x in patches], "doc_id long, start int, end int, content string")
    assert {r.doc_id: r.text for r in patch.apply(texts, p).collect()} == {1: want, 2: "other"}


def test_kinds_of_patches(spark):
    r = one(spark, a=patch.kind(span(1, 2, 1, 2)), b=patch.kind(span(1, 2, 1, 2), legacy=True), c=patch.kind(span(1, 2, 1, 3), legacy=True), d=patch.kind(span(1, 2, 1, 2), F.lit("Insert")))
    assert tuple(r) == ("Replace", "Insert", "Replace", "Insert")


@pytest.mark.parametrize(("n", "want"), [(0, ""), (1, " - r0"), (2, " - r0 or r1"), (3, " - r0, r1, or r2"), (7, " - r0, r1, r2, r3, r4, r5, or r6"), (9, " - r0, r1, r2, r3, r4, r5, r6, or one of 2 others")])
def test_replacements_text(spark, n, want):
    r = F.array(*[F.lit(f"r{k}") for k in range(n)]).cast("array<string>")
    assert one(spark, x=report.replacements_text(r)).x == want


def test_excerpts_fit(spark):
    line = "".join(f"{k % 10}" for k in range(200))
    for s, e in ((0, 5), (100, 106), (195, 200), (10, 60)):
        t, at, n = report.excerpt(F.lit(line), F.lit(s), F.lit(e), 40)
        r = one(spark, t=t, at=at, n=n)
        assert len(r.t) <= 40 and r.t[r.at : r.at + r.n] == (line[s:e] if e - s <= 20 else f"{line[s:s + 4]}...{line[e - 4:e]}")
    assert one(spark, x=report.highlight(F.lit("abcdef"), F.lit(2), F.lit(3), 1)).x == "b>c<d" and one(spark, x=report.highlight(F.lit("abc"), F.lit(2), F.lit(9))).x == "!!!"


def test_native_and_python_wrapping_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for r in docs.select("text", reflow.wrapped(F.col("text"), 50).alias("t")).collect():
        assert r.t.split("\n") == (reflow.fill(r.text.split(), 50) or [""])


def test_rules(spark):
    rules = grammar.rule_table(spark, [("a", "Style", "!{2,}", "m"), ("b", "MISSPELLING", "x", "m"), ("c", "typographical", "y", "m")])
    assert [r.rule_id for r in grammar.active(rules).collect()] == ["a"]
    d = spark.createDataFrame([(1, "a!! b!!!"), (2, "none")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.end) for r in grammar.matches(d, grammar.active(rules)).collect()) == [(1, 1, 3), (1, 5, 8)]
    assert grammar.matches(d, rules.filter("false")).count() == 0


SRC = "/// Frist line\n/// second\nfn f() {}\n// dev one\n// dev two\n/* a\nb */\n// after\n#[doc = \"more\"]\n#[doc = m!()]\n/// last\n"


def test_chunks_of_a_source(spark):
    o = spark.createDataFrame([("s", "rust", None, SRC), ("bad", "rust", None, "/* open")], "origin_id string, kind string, path string, content string")
    got = {(r.category, r.text) for r in chunks.chunks(rustlex.extract(o, True, True)).collect()}
    assert got == {("Doc", " Frist line\n second"), ("Dev", " dev one\n dev two"), ("Dev", " a\nb \n after"), ("Doc", "more\n\n last")}
    lines = SRC.split("\n")
    for r in chunks.chunks(rustlex.extract(o, True, True)).collect():
        for m in r.source_mapping:
            if m.range.end > m.range.start:
                assert lines[m.span.start.line - 1][m.span.start.col : m.span.end.col + 1] == r.text[m.range.start : m.range.end]


def test_check_fix_and_list(spark):
    o = spark.createDataFrame([("s", "rust", "s.rs", SRC), ("m", "cmark", "m.md", "# Good hed\n\nThe `cod` **frist** lin is god.\n"), ("e", "cmark", None, "")], "origin_id string, kind string, path string, content string")
    forms = spark.createDataFrame([(w,) for w in "first line second more last good head the is code".split()], "form string")
    ctx = api.Context(forms, spark.createDataFrame([("ri", "ir")], "src string, dst string"))
    found = api.check(o, ctx).cache()
    got = {(r.origin_id, r.word, r.start_line, r.start_col, r.end_col): r.replacements for r in found.collect()}
    assert set(got) == {("s", "Frist", 1, 4, 8), ("m", "hed", 1, 7, 9), ("m", "frist", 3, 12, 16), ("m", "lin", 3, 20, 22), ("m", "god", 3, 27, 29)}
    assert got["m", "frist", 3, 12, 16][0] == "first" and "line" in got["m", "lin", 3, 20, 22]
    rows = found.withColumn("finding_id", F.concat_ws(":", "origin_id", "start_line", "start_col"))
    decisions = spark.createDataFrame([("m:3:12", "1", None), ("m:1:7", "custom", "head"), ("m:3:27", "original", None), ("s:1:4", "skip", None)], "finding_id string, choice string, custom string")
    fixed = {r.origin_id: r.content for r in api.fix(o, rows, decisions).collect()}
    assert fixed["m"] == "# Good head\n\nThe `cod` **first** lin is `god`.\n" and fixed["s"] == SRC
    assert [r.path for r in api.list_origins(o).collect()] == ["e", "m.md", "s.rs"]
    every = config.masked(config.Config(), "hunspell,zspell,spellbook,nlprules")
    places = {}
    for r in findings.union(*[api.spelling(api.chunks(o), api.Context(forms, config=every), d) for d in ("hunspell", "zspell", "spellbook")]).collect():
        places.setdefault(r.detector, set()).add((r.origin_id, r.chunk_idx, r.start, r.end))
        assert r.detector == "hunspell" or r.replacements == []
    assert places["hunspell"] == places["zspell"] == places["spellbook"]
    assert api.check(o, api.Context(forms, config=every)).count() == len(got)
    assert api.reflowed(spark.createDataFrame([("w", "cmark", None, "word " * 40)], o.schema)).count() == 1


def test_grammar_goes_through_check_to_fix(spark, tmp_path):
    from quillspark.plans import dictionaries

    text = "# The title\n\nIt is a apple **and** an pear , the The end.\n\n`a apple` stays,ok\n"
    src = "/// A owl , he he said.\nstruct X;\n"
    o = spark.createDataFrame([("m", "cmark", None, text), ("s", "rust", None, src)], "origin_id string, kind string, path string, content string")
    only = config.masked(config.Config(), "nlprules")
    ctx = api.Context(spark.createDataFrame([], "form string"), config=only)
    found = api.identified(api.check(o, ctx)).cache()
    got = {(r.origin_id, r.start_line, r.start_col, r.word): r.replacements for r in found.collect()}
    assert got == {
        ("m", 3, 6, "a"): ["an"], ("m", 3, 22, "an"): ["a"], ("m", 3, 28, "r ,"): ["r,"], ("m", 3, 32, "the The"): ["the"], ("m", 5, 14, "s,o"): ["s, o"],
        ("s", 1, 4, "A"): ["An"], ("s", 1, 8, "l ,"): ["l,"], ("s", 1, 12, "he he"): ["he"],
    }
    decisions = found.select("finding_id", F.lit("1").alias("choice"), F.lit(None).cast("string").alias("custom"))
    fixed = {r.origin_id: r.content for r in api.fix(o, found, decisions).collect()}
    assert fixed == {"m": "# The title\n\nIt is an apple **and** a pear, the end.\n\n`a apple` stays, ok\n", "s": "/// An owl, he said.\nstruct X;\n"}
    (tmp_path / "rules.json").write_text('{"rule_id": "x", "category": "Style", "pattern": "(pear)", "message": "Fruit.", "replacement": "[$1]"}\n{"rule_id": "y", "category": "Typographical", "pattern": "title"}\n{"rule_id": "z"}\n')
    told = config.parse('[nlprules]\noverride_rules = "rules.json"\n', str(tmp_path))
    own = api.check(o, dictionaries.context(spark, told))
    assert [(r.word, r.replacements, r.description) for r in own.collect()] == [("pear", ["[pear]"], "Fruit.")]


def test_plain_ranges_go_back(spark):
    c = spark.createDataFrame([("o", 0, "A **bold** `code` word")], "origin_id string, chunk_idx int, text string")
    r = cmark.plain_chunks(c).select("plain", cmark.to_source(F.col("plain_map"), F.lit(2), F.lit(6)).alias("bold"), cmark.to_source(F.col("plain_map"), F.lit(7), F.lit(11)).alias("code")).first()
    assert r.plain == "A bold code word" and tuple(r.bold) == (4, 8) and r.code is None


def test_settings(tmp_path):
    c = config.parse('dev_comments = true\n[Hunspell]\nlang = "de_DE"\nsearch_dirs = ["d"]\n[Hunspell.quirks]\nallow_dashed = true\nother = 1\n[Reflow]\n', "/base")
    assert c.dev_comments and c.enabled() == ["hunspell", "reflow"] and c.hunspell.search_dirs == ["/base/d"] and c.hunspell.quirks.allow_dashes and c.hunspell.use_builtin and c.reflow.max_line_length == 80
    for bad in ("[Hunspell]\nnope = 1", "[Other]\n", '[Hunspell]\nlang = "english"'):
        with pytest.raises(ValueError):
            config.parse(bad)
    assert config.parse(config.to_toml(c), "/base") == c
    assert config.masked(config.Config(), None).enabled() == ["hunspell"] and config.masked(config.Config(), "Zet, reflow").enabled() == ["zspell", "reflow"]
    config.write(c, f"{tmp_path}/.config/spellcheck.toml")
    assert config.find(cwd=str(tmp_path), home=str(tmp_path)).dev_comments
    with pytest.raises(FileExistsError):
        config.write(c, f"{tmp_path}/.config/spellcheck.toml")
    for n in ("a/de_DE.dic", "b/de_DE.dic", "b/de_DE.aff"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("1\nx\n")
    assert config.dictionary_paths("de_DE", [f"{tmp_path}/a", f"{tmp_path}/b"], True) == (f"{tmp_path}/b/de_DE.dic", f"{tmp_path}/b/de_DE.aff")
    assert config.dictionary_paths("de_DE", [f"{tmp_path}/a"], True) is None


@pytest.fixture
def tree(tmp_path):
    files = {
        "Cargo.toml": '[package]\nname = "t"\nreadme = "README.md"\ndescription = "What it\'s for"\n[workspace]\nmembers = ["parts/*"]\n[[bin]]\nname = "b"\npath = "src/main.rs"\n', "src/main.rs": "mod one;\nmod gone;\nfn main() {}\n", "README.md": "# Read\n", "src/lib.rs": "mod two { mod three; }\n//! lib\n",
        "src/one.rs": "mod deep;\n", "src/one/deep.rs": "", "src/two.rs": "", "src/three.rs": "", "src/loose.rs": "", "parts/p/Cargo.toml": '[package]\nname = "p"\n', "parts/p/src/lib.rs": "", "parts/p/README.md": "",
        "plain/x.rs": "", "plain/y.md": "", "plain/z.txt": "", "plain/sub/w.rs": "", "plain/ignored.rs": "", "plain/.gitignore": "ignored.rs\n",
    }
    for n, t in files.items():
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(t)
    return tmp_path


def test_projects(spark, tree):
    names = lambda xs: sorted(str(x).removeprefix(f"{tree}/") for x in xs)
    found = project.extract([str(tree)], descriptions=True)
    assert names(found.rust) == sorted(f"{n}.rs" for n in ("parts/p/src/lib", "src/three", "src/main", "src/one/deep", "src/lib", "src/one"))
    assert names(found.markdown) == ["README.md"] and found.descriptions[0][1] == "What it's for"
    assert project.extract([str(tree)], skip_readme=True).markdown == []
    flat, deep = project.extract([f"{tree}/plain"]), project.extract([f"{tree}/plain"], recurse=True)
    assert names(flat.rust) == ["plain/x.rs"] and names(flat.markdown) == ["plain/y.md"] and names(deep.rust) == ["plain/sub/w.rs", "plain/x.rs"]
    assert names(project.seed(f"{tree}/plain")) == ["plain/x.rs"]
    assert names(project.closure(f"{tree}/src/main.rs", 1)) == ["src/main.rs", "src/one.rs"]
    assert project.extract([f"{tree}/plain/z.txt", f"{tree}/nowhere"]) == project.Found()
    (tree / "src/one/mod.rs").write_text("")
    with pytest.raises(ValueError, match="2 places"):
        project.module_file(f"{tree}/src/main.rs", "one")
    rows = readers.from_project(spark, found).collect()
    assert sorted(r.kind for r in rows) == ["cmark", "description", *["rust"] * 6]
    value, place = readers.description_span((tree / "Cargo.toml").read_text())
    text = (tree / "Cargo.toml").read_text()
    assert one(spark, x=readers.load_span(F.lit(text), *map(F.lit, place))).x == value


def test_streams(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(50)
    docs.write.parquet(f"{tmp_path}/in")
    forms = spark.createDataFrame([("the",), ("of",)], "form string")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    q = incremental.unknown_words(stream, forms).writeStream.format("memory").queryName("unknown_words").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("unknown_words").count() == incremental.unknown_words(docs, forms).count() > 0
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/ev")
    q = incremental.counts_by_window(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")).writeStream.outputMode("complete").format("memory").queryName("by_window").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.window_start, r.event_type, r.n) for r in spark.table("by_window").collect()) == sorted((r.window_start, r.event_type, r.n) for r in incremental.counts_by_window(events).collect())


def test_long_words_are_taken_apart_to_the_end():
    word = ".".join(f"x{k}" for k in range(40))
    assert [t for _, _, t in W.transform(word, [r"^(.+?)[.](.+)$"])[1]] == word.split(".")


def test_no_row_is_lost_as_an_origin(spark):
    from quillspark.sources import readers

    rows = [("a", "one"), ("a", "two"), ("a", "two"), ("b", "same"), ("b", "same"), ("c", None), (None, "x"), (None, "y"), (None, "x"), ("d", "two")]
    got = sorted((r.origin_id, r.content) for r in readers.from_rows(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect())
    own = lambda k, t: f"{k}#{hashlib.md5(t.encode()).hexdigest()}"
    assert got == sorted([(own("a", "one"), "one"), (own("a", "two"), "two"), ("b", "same"), ("c", ""), (own("", "x"), "x"), (own("", "y"), "y"), ("d", "two")])


def test_sources_that_do_not_lex_are_told(spark):
    from quillspark.plans import api
    from quillspark.sources import modules

    rows = [("a.rs", "rust", None, "/// fine\nmod x;"), ("b.rs", "rust", None, "/* open\nmod y;"), ("c.md", "cmark", None, "/* text")]
    o = spark.createDataFrame(rows, "origin_id string, kind string, path string, content string")
    assert [tuple(r) for r in api.unreadable(o).collect()] == [("b.rs", "a block comment is not closed")]
    assert {r.origin_id for r in api.chunks(o, True).collect()} == {"a.rs", "c.md"}
    files = o.filter("kind = 'rust'").select(F.col("origin_id").alias("path"), "content")
    assert [tuple(r) for r in modules.declared(files).collect()] == [("a.rs", "x")] and [r.path for r in modules.unreadable(files).collect()] == ["b.rs"]


def test_many_doc_attributes_take_linear_time():
    import time

    def took(n):
        src = '#[doc = "text"]\n' * n
        t = time.process_time()
        assert len(rustlex.literals(src)) == n
        return time.process_time() - t

    took(500)
    assert took(16_000) < 12 * max(took(4_000), 0.02)


def test_ignore_files_of_parents_and_exceptions(tmp_path):
    for name in (".git/x", "a.rs", "gen/b.rs", "gen/keep.rs", "src/c_test.rs", "src/deep/d.rs", "src/deep/build/e.rs", "src/only/f.rs", "other/only/g.rs", "x#1.rs"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    (tmp_path / ".gitignore").write_text("# all of these\ngen/*\n!gen/keep.rs\n*_test.rs\nbuild/\n/src/only\n\\#none\n")
    (tmp_path / "src/deep/.gitignore").write_text("!*.md\n")
    found = [os.path.relpath(p, tmp_path) for p in project.extract([str(tmp_path)], recurse=True).rust]
    assert found == ["a.rs", "gen/keep.rs", "other/only/g.rs", "src/deep/d.rs", "x#1.rs"]
    deep = [os.path.relpath(p, tmp_path) for p in project.extract([str(tmp_path / "src")], recurse=True).rust]
    assert deep == ["src/deep/d.rs"]
    assert project.seed(str(tmp_path / "gen")) == [str(tmp_path / "gen/keep.rs")]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from quillspark import tables

    def session(master):
        own = []
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: own[0] if own else None, setCheckpointDir=own.append))

    for master in ("spark://host:7077", "local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.shared_dir(session(master))
    assert tables.shared_dir(session("local[4]")).startswith("file://")


def test_tables_of_a_run_are_released(spark, monkeypatch):
    from quillspark import tables

    run = f"{tables.shared_dir(spark)}/quillspark/another-run"
    monkeypatch.setattr(tables, "_run_dir", lambda _: run)
    df = tables.cut(spark.range(3), "three")
    assert df.count() == 3 and os.path.isdir(run.removeprefix("file://"))
    tables.release(spark)
    assert not os.path.isdir(run.removeprefix("file://"))
