"""What a task, a worker or the driver holds does not grow with the input; results stay whole."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import words as W
from quillspark.operators import batches, chunks, reflow, report, rustlex, tokens
from quillspark.plans import registry
from quillspark.sources import modules
from quillspark.tables import pieces

from .conftest import SF


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_closure_reads_its_depths_from_one_folder(spark):
    edges = spark.createDataFrame([(f"f{k}", f"f{2 * k + x}") for k in range(1, 32) for x in (0, 1)] + [("f9", "f1")], "parent string, child string")
    got = modules.closure(spark.createDataFrame([("f1",), ("f1",)], "path string"), edges)
    assert "Union" not in _plan(got) and "LogicalRDD" not in _plan(got)
    assert {r.path: r.depth for r in got.collect()} == {f"f{k}": k.bit_length() - 1 for k in range(1, 64)} and got.count() == 63


def test_places_of_modules_are_dealt_by_size(spark):
    files = spark.range(20_000_000).select(F.concat(F.lit("src/"), F.col("id").cast("string")).alias("path"), F.lit("mod a;").alias("content"))
    n = pieces(files, modules._FILES)
    assert n > 4 and f", {n}" in _plan(modules.resolved(files.select(F.col("path").alias("parent"), F.lit("a").alias("name")), files))


class _Batch:
    """A batch whose columns can be read row by row only."""

    def __init__(self, b):
        self.b, self.num_rows, self.num_columns = b, b.num_rows, b.num_columns
        self.columns = [_Column(c) for c in b.columns]

    def column(self, k):
        return self.columns[k]


class _Column:
    def __init__(self, c):
        self.c = c

    def __getitem__(self, k):
        return self.c[k]

    def take(self, at):
        return self.c.take(at)


def _passes(spark, monkeypatch, df_of, text, n):
    """Sizes of the batches that the Arrow pass of df_of(texts) makes of n rows of a text, and their rows."""
    held = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema, *a, **b: held.append((self, f)) or spark.createDataFrame([], schema))
    df_of(spark.createDataFrame([(1, "1", text)], "doc_id long, origin_id string, text string"))
    monkeypatch.undo()
    df, f = held[-1]
    b = df.toArrow().to_batches()[0]
    many = pa.Table.from_batches([b] * n).combine_chunks().to_batches()[0]
    out = list(f(iter([_Batch(many)])))
    return [x.num_rows for x in out], pa.Table.from_batches(out).to_pylist()


def test_extraction_goes_on_in_parts(spark, monkeypatch):
    sizes, rows = _passes(spark, monkeypatch, lambda d: rustlex.extract(d, content_col="text"), "/// one\nstruct X;\n/// two\n" * 100, 300)
    assert len(rows) == 60_000 and max(sizes) <= batches.MOST_ROWS and {r["text"] for r in rows} == {" one", " two"} and max(r["lit_idx"] for r in rows) == 199


def test_tokens_go_on_in_parts(spark, monkeypatch):
    sizes, rows = _passes(spark, monkeypatch, lambda d: tokens.tokenize_chunks(d, ("doc_id",), "text"), "isn't a b " * 500, 50)
    assert len(rows) == 75_000 and max(sizes) <= batches.MOST_ROWS and rows[-1] == {"doc_id": 1, "tok_idx": 1499, "start": 4998, "end": 4999, "token": "b"}
    sizes, rows = _passes(spark, monkeypatch, lambda d: tokens.token_lists(d, ("doc_id",), "text"), "isn't a b " * 5000, 100)
    assert len(sizes) > 4 and len(rows) == 100 and rows[0]["tokens"] == ["isn't", "a", "b"] * 5000


def test_token_counts_take_rows_of_an_id_together(spark, tmp_path):
    spark.createDataFrame([(1, "wordsmith it b"), (1, "a"), (2, ""), (3, None), (4, " ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["token_stage_merge"](spark, str(tmp_path))
    want = hashlib.md5("\n".join(sorted(["wordsmith's", "it", "b", "a"])).encode()).hexdigest()
    assert [tuple(r) for r in got.collect()] == [(1, 4, 1, want)] and "Generate" not in _plan(got)


def test_wrapped_paragraphs_go_on_in_parts(spark, monkeypatch):
    text = "some words that go on\nand on " * 400
    sizes, rows = _passes(spark, monkeypatch, lambda d: reflow.reflow(d, 40, ("doc_id",)), text, 200)
    assert len(rows) == 200 and max(sizes) < 200 and rows[0]["start"] == 0


def test_wrapped_comments_go_on_in_parts(spark, monkeypatch):
    literals = lambda d: chunks.chunks(rustlex.extract(d, content_col="text")).withColumn("delimiter", F.lit(None).cast("string"))
    rows = literals(spark.createDataFrame([("1", "/// " + "words go on " * 2000)], "origin_id string, text string")).collect()
    schema = literals(spark.createDataFrame([], "origin_id string, text string")).schema
    sizes, got = _passes(spark, monkeypatch, lambda _: reflow.reflow_chunks(spark.createDataFrame(rows, schema)), "", 120)
    assert len(got) == 120 and max(sizes) < 120


def test_places_of_words_are_found_a_part_of_a_text_at_a_time(spark, monkeypatch):
    sizes, rows = _passes(spark, monkeypatch, lambda d: tokens.word_table(d, places=True, least=4), "long and\nlonger " * 30_000, 2)
    assert max(sizes) <= 2 * batches.MOST_ROWS and len(rows) == 120_000
    assert rows[0] == {"doc_id": 1, "tok_idx": 0, "word": "long", "start_off": 0, "line_no": 1, "col": 0} and rows[-1]["tok_idx"] == 89_999 and rows[-1]["line_no"] == 30_001


def test_findings_come_from_one_pass(spark):
    assert _plan(registry.queries()["findings_union"](spark, SF)).count("MapInArrow") == 1


def test_windows_over_findings_are_dealt_by_document(spark):
    for name in ("overlap_filtered", "findings_sorted"):
        assert "RepartitionByExpression [doc_id" in _plan(registry.queries()[name](spark, SF))


def test_blocks_of_findings_name_each_step_once(spark):
    df = spark.range(3).select(report.render(F.lit("d"), F.lit("p"), F.lit(1), F.concat(F.lit("x" * 99), F.col("id").cast("string")), F.lit(90), F.lit(95), F.array(F.lit("r")), F.lit(None).cast("string")).alias("b"))
    assert _plan(df).count("id#") < 40 and {r.b.split(" | ")[1].split("\n")[0][-8:] for r in df.collect()} == {f"xxxxxxx{k}" for k in range(3)}


def test_places_of_unknown_words_come_from_one_pass(spark, tmp_path):
    spark.createDataFrame([(1, "Known bad KNOWN 11th bad kNown"), (1, "bad"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("known",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["misspelled"](spark, str(tmp_path))
    assert _plan(got).count("MapInArrow") == 1
    want = [(1, "bad", 3, 0), (1, "kNown", 1, 25)]
    assert sorted(map(tuple, got.collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # the plan for large lexicons
        large = registry.queries()["misspelled"](spark, str(tmp_path))
        assert _plan(large).count("MapInArrow") == 2 and sorted(map(tuple, large.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_detectors_look_up_distinct_words(spark, tmp_path):
    spark.createDataFrame([(1, "known bad bad"), (1, "bad worse"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("known",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["spell_agreement"](spark, str(tmp_path))
    assert "posexplode" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == [(d, 4, 0) for d in ("hunspell", "spellbook", "zspell")]


def test_listed_words_go_in_the_pass_that_finds_them(spark, tmp_path):
    spark.createDataFrame([(1, "12 12. a@b word 12x word"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["transform_whitelist"](spark, str(tmp_path))
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.word for r in got.collect()) == ["12x", "word"]
    words = ["a1b1c", "same", "12", "zz", "(x", ""]
    for patterns in ([r"^(\w+)1(\w)$", "^(same)$", "^[0-9]+$"], ["(", "^zz$"], ["^12$", "("]):
        rows = W.transformed(spark.createDataFrame([(w,) for w in words], "word string"), patterns).collect()
        assert {r.word: (r.outcome, [tuple(x) for x in r.fragments]) for r in rows} == {w: W.transform(w, patterns) for w in words}


def test_words_are_taken_apart_once(spark, tmp_path):
    spark.createDataFrame([(1, "well-known well-known a- word -b x#y-z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["transform_fragments"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 0
    assert sorted(map(tuple, got.collect())) == [("a-", "a", ""), ("well-known", "well", "known"), ("x#y-z", "x", "y")]
