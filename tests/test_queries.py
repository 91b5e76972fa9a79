"""Every query with SQL gives what DuckDB gives; the others give rows; what stays when optional parts are gone."""

import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import registry

from .conftest import ROOT, SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _rows(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = _rows([r[names.index(c)] for c in cols] for r in cur.fetchall())
    assert _rows([r[c] for c in cols] for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and e.oracle_sql() and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, check=True)


def test_errors_inside_optional_parts_are_not_swallowed(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    llm = tmp_path / "repo/quillspark/llm"
    llm.mkdir()
    (llm / "__init__.py").write_text("")
    (llm / "queries.py").write_text("import there_is_no_such_module\n")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, check=False)
    assert got.returncode and "there_is_no_such_module" in got.stderr


def test_every_finding_is_rendered_with_its_line(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillspark.operators import report

    texts = [f"short {'x' * 150} words anotherword\nthe second lïne has {'y' * 25} and wordsenough " + "tail words follow " * 40, "", None, "nothing", "a" * 30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.start_line, r.start_col): r.block for r in registry.queries()["render_findings"](spark, str(tmp_path)).collect()}
    rows = [(k, no, m.start(), m[0], line) for k, t in enumerate(texts) for no, line in enumerate((t or "").split("\n"), 1) for m in re.finditer(r"\w{9,}", line)]
    whole = spark.createDataFrame(rows, "doc_id long, no int, col int, word string, line string")
    block = report.render(F.lit("hunspell"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("no"), F.col("line"), F.col("col"), F.col("col") + F.char_length("word"), F.array(F.concat("word", F.lit("s"))), F.lit(None).cast("string"))
    assert len(rows) == 5 and got == {(r.doc_id, r.no, r.col): r.block for r in whole.select("doc_id", "no", "col", block.alias("block")).collect()}
    assert f"1 | {'a' * 30}\n" in got[4, 1, 0]  # a line that fits stays
    assert "yyyy...yyyy" in got[0, 2, 20] and all(len(line) <= 80 for b in got.values() for line in b.split("\n") if line[0].isdigit())


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_word_gets_suggestions(spark, tmp_path):
    known = "été naïve größe straße слово word2 item10 naive words a 日本語 résumé"
    bad = "éte naïv Größee straßen слова wrod2 Item11 Words1 zzzzzzzz 日本誌 resume Été2"
    spark.createDataFrame([(1, bad)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, known)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.word, r.form, r.distance, r.rank) for r in registry.queries()["suggest_every_word"](spark, str(tmp_path)).collect()}
    want = set()
    for w in bad.split():
        near = sorted((d, f) for f in known.split() if 1 <= (d := _distance(w, f)) <= 2)
        want |= {(w, f, d, k) for k, (d, f) in enumerate(near, 1)}
    assert got == want and {w for w, *_ in got} >= {"éte", "слова", "Größee", "wrod2", "日本誌"}
