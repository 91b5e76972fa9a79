"""Wrapping in place, dictionaries from files, sinks and the actions at a shell."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark import __main__ as shell
from quillspark.functions import comments, positions
from quillspark.operators import reflow
from quillspark.plans import api, config, dictionaries
from quillspark.sources import modules, sinks
from quillspark.streaming import incremental

AFF = "SET ISO8859-1\nPFX A Y 1\nPFX A 0 re .\nSFX S Y 1\nSFX S 0 s .\nREP 1\nREP ie ei\n"
ORIGIN = "origin_id string, kind string, path string, content string"


def origins(spark, content, kind="rust"):
    return spark.createDataFrame([("o", kind, "o.rs", content)], ORIGIN)


def wrapped(spark, content, width, kind="rust", dev=False):
    c = config.Config(dev_comments=dev, reflow=config.Reflow(width))
    return api.rewrapped(origins(spark, content, kind), c).first().content


WRAPS = [
    ("/// Seven words that are wider than thirty\n/// columns.\nfn f() {}\n", 30, "/// Seven words that are wider\n/// than thirty columns.\nfn f() {}\n"),
    ("    //! Inside of a block,\n    //! in two lines\n", 60, "    //! Inside of a block, in two lines\n"),
    ("/// fits\n///\n/// fits too\n", 40, "/// fits\n///\n/// fits too\n"),
    ("/// a first line\n/// and a second one that is far too wide\n", 20, "/// a first line and\n/// a second one\n/// that is far too\n/// wide\n"),
    ("  #[doc = r#\"Raw text that is too wide\"#]\n  struct S;\n", 30, "  #[doc = r#\"Raw text that is\"#]\n  #[doc = r#\"too wide\"#]\n  struct S;\n"),
    ("#[doc = \"plain text of a macro\"]\n", 22, "#[doc = \"plain text of\"]\n#[doc = \"a macro\"]\n"),
    ("/** a block comment that is wider than ten columns */\n", 10, "/** a block comment that is wider than ten columns */\n"),
    ("/// 🚤🌴 words\r\n/// with emoji\r\nfn f() {}\r\n", 13, "/// 🚤🌴 words\r\n/// with\r\n/// emoji\r\nfn f() {}\r\n"),
]


@pytest.mark.parametrize(("content", "width", "want"), WRAPS)
def test_comments_are_wrapped_in_place(spark, content, width, want):
    assert wrapped(spark, content, width) == want
    assert wrapped(spark, want, width) == want


def test_developer_comments_are_wrapped_if_asked_for(spark):
    src = "// words of a developer that go on\nlet x = 1;\n"
    assert wrapped(spark, src, 20) == src
    assert "let x = 1;\n" in wrapped(spark, src, 20, dev=True) != src


def test_markdown_is_wrapped_in_place(spark):
    text = "# A heading that is left alone, wide as it may be\n\nSome words [with a link](target) and more\nof them.\n\n- item\n"
    assert wrapped(spark, text, 24, "cmark") == "# A heading that is left alone, wide as it may be\n\nSome words\n[with a link](target)\nand more of them.\n\n- item\n"


def test_marks_agree_with_columns(spark):
    rows = spark.createDataFrame([(t, "#[doc = ", h) for t in comments.VARIANTS for h in range(4)], "tag string, p string, h int")
    for r in rows.select("*", comments.prefix(F.col("tag"), F.col("p"), F.col("h")).alias("a"), comments.suffix(F.col("tag"), F.col("h")).alias("b")).collect():
        a, b = comments.marks(r.tag, r.p, r.h)
        assert (a, b.removesuffix("]")) == (r.a, r.b.removesuffix("]"))


def test_places_of_a_chunk():
    p = reflow.Placed("ab\ncd\nef", [{"range": {"start": 0, "end": 5}, "span": {"start": {"line": 3, "col": 4}}}, {"range": {"start": 6, "end": 8}, "span": {"start": {"line": 9, "col": 1}}}])
    assert [p.place(k) for k in (0, 1, 3, 4, 6, 7)] == [(3, 4), (3, 5), (4, 0), (4, 1), (9, 1), (9, 2)]
    assert p.columns(1, 8, 0) == [5, 5, 1] and p.columns(0, 2, 1) == [4]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/en_US.aff").write_text(AFF)
    (tmp_path / "d/en_US.dic").write_bytes("4\nword/S\nname/AS\ncafé\nbelief\n".encode("iso8859-1"))
    (tmp_path / "d/more.dic").write_text("1\nown\n")
    (tmp_path / "a.md").write_text("# words belief\n\nA nmae, own café; beleif.\n")
    (tmp_path / "b.rs").write_text("/// rename wrod\nmod c;\n// nope\n")
    (tmp_path / "c.rs").write_text("//! name\n")
    (tmp_path / "s.toml").write_text('[Hunspell]\nsearch_dirs = ["d"]\nskip_os_lookups = true\nextra_dictionaries = ["more.dic"]\n[Reflow]\nmax_line_length = 12\n')
    return tmp_path


def test_dictionaries(spark, folder):
    section = config.parse((folder / "s.toml").read_text(), str(folder)).hunspell
    cache = f"{folder}/cache"
    forms, pairs = dictionaries.load(spark, section, cache)
    want = {"word", "words", "name", "names", "rename", "renames", "café", "belief", "own"}
    assert {r.form for r in forms.collect()} == want and pairs == [("ie", "ei")]
    assert len(os.listdir(cache)) == 1
    built = []
    again = dictionaries.cached(spark, cache, "other", lambda: built.append(1) or forms)
    assert again.count() == len(want) == dictionaries.cached(spark, cache, "other", lambda: built.append(1) or forms).count() and built == [1]
    assert len(os.listdir(cache)) == 2
    section.extra_dictionaries = ["gone.dic"]
    with pytest.raises(FileNotFoundError):
        dictionaries.load(spark, section)
    section.search_dirs = []
    with pytest.raises(FileNotFoundError):
        dictionaries.load(spark, section)
    (folder / "d/more.dic").write_text("own\n")
    with pytest.raises(ValueError, match="no dictionary"):
        dictionaries.word_lines(spark, f"{folder}/d/more.dic")


def test_check_and_fix_at_a_shell(spark, folder, capsys):
    cfg = ["-c", f"{folder}/s.toml"]
    paths = [f"{folder}/a.md", f"{folder}/b.rs"]
    assert shell.main(["list-files", "-r", *paths], spark) == 0
    assert capsys.readouterr().out.split() == [f"{folder}/{n}" for n in ("a.md", "b.rs", "c.rs")]
    assert shell.main(["check", "-r", "-m", "7", *cfg, *paths], spark) == 7
    out = capsys.readouterr().out
    assert [line for line in out.split("\n") if "-->" in line] == [f" --> file:{folder}/{p}" for p in ("a.md:3", "a.md:3", "a.md:3", "b.rs:1")] and "^^^^ - name" in out
    assert shell.main(["check", *cfg, f"{folder}/c.rs"], spark) == 0 and capsys.readouterr().out == ""
    assert shell.main(["fix", *cfg, "--ask", f"{folder}/ask.csv", *paths], spark) == 0
    asked = (folder / "ask.csv").read_text().splitlines()
    assert asked[0] == "finding_id,choice,custom,word,replacements" and {line.split(",")[3] for line in asked[1:]} == {"nmae", "beleif", "wrod"}
    (folder / "ask.csv").write_text("\n".join([asked[0], *(line.replace(",,,", ",1,,") for line in asked[1:] if "nmae" in line)]) + "\n")
    assert shell.main(["fix", *cfg, "--decisions", f"{folder}/ask.csv", *paths], spark) == 0
    assert "A name, own" in (folder / "a.md").read_text() and "wrod" in (folder / "b.rs").read_text()
    assert shell.main(["fix", *cfg, "--first", *paths], spark) == 0
    assert (folder / "a.md").read_text() == "# words belief\n\nA name, own café; belief.\n" and (folder / "b.rs").read_text() == "/// rename word\nmod c;\n// nope\n"
    assert not [n for n in os.listdir(folder) if n.startswith(".quillspark")]


def test_reflow_and_settings_at_a_shell(spark, folder, capsys):
    assert shell.main(["reflow", "-c", f"{folder}/s.toml", f"{folder}/a.md", f"{folder}/b.rs"], spark) == 0
    assert (folder / "a.md").read_text() == "# words belief\n\nA nmae, own\ncafé;\nbeleif.\n" and (folder / "b.rs").read_text().startswith("/// rename\n/// wrod\nmod c;")
    capsys.readouterr()
    assert shell.main(["config", "--stdout", "--filter", "hunspell,reflow"]) == 0
    assert config.parse(capsys.readouterr().out).enabled() == ["hunspell", "reflow"]
    assert shell.main(["config", "--cfg", f"{folder}/new.toml"]) == 0 and config.parse((folder / "new.toml").read_text()) == config.full()
    with pytest.raises(FileExistsError):
        shell.main(["config", "--cfg", f"{folder}/new.toml"])
    assert shell.main(["config", "--cfg", f"{folder}/new.toml", "--overwrite"]) == 0
    with pytest.raises(SystemExit):
        shell.main(["config"])
    assert shell.main(["check", f"{folder}/none"], spark) == 0


def test_more_checkers(spark):
    o = origins(spark, "`code` two words\n", "cmark")
    c = config.Config(hunspell=None)
    got = api.check(o, api.Context(spark.createDataFrame([], "form string"), config=c, more={"dummy": api.dummy})).collect()
    assert [(r.word, r.start_col, r.replacements) for r in got] == [("two", 7, ["replacement_1"]), ("words", 11, ["replacement_2"])]
    with pytest.raises(ValueError, match="no checker"):
        api.check(o, api.Context(spark.createDataFrame([], "form string"), config=c))


def test_sinks(spark, tmp_path):
    o = origins(spark, "one\ntwo wrod\n", "cmark")
    found = api.identified(api.check(o, api.Context(spark.createDataFrame([("one",), ("two",)], "form string"))))
    sinks.write_blocks(api.blocks(o, found), f"{tmp_path}/blocks")
    told = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/blocks").collect())
    assert "--> o.rs:2" in told and "2 | two wrod" in told
    sinks.write_texts(o.select("origin_id", "content"), f"{tmp_path}/texts")
    assert spark.read.parquet(f"{tmp_path}/texts").count() == 1
    with pytest.raises(OSError):
        sinks.replace_file(f"{tmp_path}/gone/x", "text")


def test_byte_ranges(spark):
    text = "aé🌡b"  # bytes: 1, 2, 4, 1
    for s in range(10):
        for e in range(s, 10):
            got = spark.range(1).select(positions.byte_range_to_chars(F.lit(text), F.lit(s), F.lit(e)).alias("r")).first().r
            cut = [k for k, (a, b) in enumerate([(0, 1), (1, 3), (3, 7), (7, 8)]) if a < e and b > s]
            if s >= 8:
                assert got is None
            elif e > s:
                assert tuple(got) == (cut[0], cut[-1] + 1)


def test_modules_of_many_files(spark):
    files = {"a/lib.rs": "mod x; mod y; mod z;", "a/x.rs": "mod deep;", "a/x/deep.rs": "mod deep;", "a/y.rs": "", "a/y/mod.rs": "", "b/main.rs": "mod main;", "bad.rs": "mod lib; /*", "lib.rs": "mod a;", "a/mod.rs": "mod lib;"}
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    d = modules.declared(df)
    edges = modules.resolved(d, df)
    assert {(r.parent, r.child) for r in edges.collect()} == {("a/lib.rs", "a/x.rs"), ("a/x.rs", "a/x/deep.rs"), ("a/x/deep.rs", "a/x/deep.rs"), ("b/main.rs", "b/main.rs"), ("lib.rs", "a/mod.rs"), ("a/mod.rs", "a/lib.rs")}
    assert [(r.parent, r.name, r.n) for r in modules.ambiguous(d, df).collect()] == [("a/lib.rs", "y", 2)]
    got = {r.path: r.depth for r in modules.closure(df.filter("path in ('lib.rs', 'b/main.rs')"), edges).collect()}
    assert got == {"lib.rs": 0, "b/main.rs": 0, "a/mod.rs": 1, "a/lib.rs": 2, "a/x.rs": 3, "a/x/deep.rs": 4}
    assert modules.closure(df.filter("path = 'lib.rs'"), edges, 1).count() == 2


def test_origins_are_checked_as_they_arrive(spark, tmp_path):
    forms = spark.createDataFrame([("one",), ("two",)], "form string")
    ctx = api.Context(forms)
    first = spark.createDataFrame([("a", "cmark", None, "one wrod\n"), ("b", "rust", None, "/// twi two\n")], ORIGIN)
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ORIGIN).parquet(f"{tmp_path}/in")

    def run():
        q = incremental.check_batches(stream, ctx, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([("c", "cmark", None, "two\nthere\n")], ORIGIN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = sorted((r.batch, r.origin_id, r.word, r.start_line, r.start_col) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "a", "wrod", 1, 4), (0, "b", "twi", 1, 4), (1, "c", "there", 2, 0)]
