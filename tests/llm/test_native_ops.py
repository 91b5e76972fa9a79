"""op3, op9, op10: against Python, and their SQL on odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import iblt, linededup, mixing
from quillspark.llm import queries as Q

from ..conftest import SF
from .conftest import data, rows


def _units(text):
    return set(re.findall(r"\S+(?:[^\S\n]+\S+){0,%d}" % (iblt.WORDS - 1), text))


def _likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _edited(ordered):
    out = []
    for k, (i, t) in enumerate(ordered):
        n = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), _likeness(_units(t), _units(e)), _likeness(_units(t), _units(n))))
    return out


def _compare(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[3:] == pytest.approx(w[3:], abs=1e-12)


def _fingerprints(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in iblt.fingerprints(df).collect()]


def test_fingerprints_of_odd_documents(odd):
    pairs = [(k, t or "") for k, t in data()]
    ordered = sorted((p for p in pairs if p[0] is not None), key=lambda p: -p[0]) + [p for p in pairs if p[0] is None]
    _compare(_fingerprints(odd), _edited(ordered))


def test_fingerprints_of_few_documents(spark, empty):
    assert iblt.fingerprints(empty).collect() == []
    one = spark.createDataFrame([(5, "a b\nc d")], "doc_id long, text string")
    _compare(_fingerprints(one), _edited([(5, "a b\nc d")]))
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [r.near_next for r in iblt.fingerprints(nulls).collect()] == [1.0, 1.0]


@pytest.mark.parametrize("size", [1, 7, 4000])
def test_neighbours_meet_however_buckets_are_cut(spark, monkeypatch, size):
    monkeypatch.setattr(iblt, "BUCKET_ROWS", size)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 3 <> 1")
    ordered = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda p: -p[0])
    _compare(_fingerprints(docs), _edited(ordered))


@pytest.mark.parametrize("bits", [16, 3])
def test_the_digests_that_differ_are_recovered_on_their_side(spark, monkeypatch, bits):
    """By brute force over all digests, for pairs with few and with very many differences; with 3 bits of check, cells of several digests often pass for one."""
    monkeypatch.setattr(iblt, "_check", lambda x: F.xxhash64(x).bitwiseAND((1 << bits) - 1))
    words = lambda tag, n: "\n".join(f"{tag} paragraph {k}" for k in range(n))
    texts = [words("a", 30), words("a", 30) + "\nb", words("c", 300), words("c", 299) + "\nd", "", words("e", 2000), *(words(f"f{k}", k) for k in range(1, 40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r.doc_id: set(r.ks) for r in df.select("doc_id", iblt.digests(F.col("text")).alias("ks")).collect()}
    got = {r.doc_id: r for r in iblt.fingerprints(df).collect()}
    half = lambda k: texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[(k - 1) % len(texts)][: len(texts[k]) // 2]
    edited = {r.doc_id: set(r.ks) for r in spark.createDataFrame([(k, half(k)) for k in keys], "doc_id long, text string").select("doc_id", iblt.digests(F.col("text")).alias("ks")).collect()}
    for k, own in keys.items():
        other = keys[(k - 1) % len(texts)]
        assert (set(got[k].next_lost), set(got[k].next_gained)) == (own - other, other - own)
        assert (set(got[k].edited_lost), set(got[k].edited_gained)) == (own - edited[k], edited[k] - own)


def test_equal_texts_have_equal_fingerprints(odd):
    seen = defaultdict(set)
    for r, t in zip(iblt.fingerprints(odd).orderBy("doc_id").collect(), sorted(data(), key=lambda p: (p[0] is not None, p[0] or 0)), strict=True):
        seen[t[1] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in seen.values()) and len({next(iter(x)) for x in seen.values()}) >= len(seen) - 2  # blank texts are alike


def test_peeling_recovers_differences_and_reports_failure(spark):
    shape = (4, 3)
    sets = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.col("id") % 40 + 1), lambda k: F.shiftleft(F.xxhash64(k, F.col("id")), 16)).alias("raw"))
    sets = sets.select(F.transform("raw", lambda x: x.bitwiseOR(iblt._check(F.shiftrightunsigned(x, 16)))).alias("keys"))
    got = sets.select("keys", F.size("keys").alias("n"), iblt.peel(iblt.sketch(F.col("keys"), shape), shape).alias("p")).collect()
    done = [r for r in got if r.p.done]
    assert all(sorted(r.p.found) == sorted(r["keys"]) for r in done)
    assert sum(r.p.done for r in got if r.n <= 10) > 0.95 * sum(r.n <= 10 for r in got)
    assert not any(r.p.done for r in got if r.n > 36)  # more digests than cells


def test_fingerprint_plan_has_no_python(spark):
    plan = iblt.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_fingerprints_are_small_hex_without_tables_of_case(spark):
    """lower() and upper() build tables for all of Unicode, on which an executor's heap grows by hundreds of MB."""
    cells = [0, 1, -1, 0x0123456789ABCDEF, -0x123456789ABCDEF0]
    got = spark.createDataFrame([(cells,)], "cells array<bigint>").select(iblt.as_text(F.col("cells")).alias("t")).first().t
    assert got == "-".join(f"{c % (1 << 64):x}" for c in cells)
    plan = Q.op3_fingerprints(spark, SF)._jdf.queryExecution().toString()
    assert "hex(" in plan and not re.search(r"\b(lower|upper)\(", plan)


SQL_SCHEMA = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT"


def _duck(sql, table):
    c = duckdb.connect()
    c.execute(f"CREATE TABLE documents ({SQL_SCHEMA})")
    if table:
        c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in table])
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def _same(df, sql, table):
    want = _duck(sql, table)
    cols = sorted(df.columns)
    flat = lambda r: tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols)
    assert sorted(map(flat, (r.asDict() for r in df.collect())), key=str) == sorted(map(flat, want), key=str)


def test_mixing_of_odd_documents(odd, empty):
    unique = rows()[:-2]  # the SQL joins documents of one hash; repeated ids are tested below
    _same(mixing.mix(odd.filter("doc_id is not null").dropDuplicates(["doc_id"])).drop("copies"), mixing.SQL, unique)
    assert mixing.mix(empty).collect() == []


def test_mixing_takes_repeated_rows_together(odd):
    got = defaultdict(set)
    for r in mixing.mix(odd).collect():
        got[r.doc_id].add((r.size, r.taken))
    assert all(len(x) == 1 for x in got.values())


def test_mixing_meets_its_targets_and_agrees(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 50 + 1), ["a", "b", "c", None][0 if k % 3 else k % 4]) for k in range(6000)], "doc_id long, text string, source string")
    first, again = (sorted(tuple(r) for r in mixing.mix(docs.repartition(n)).collect()) for n in (2, 7))
    assert first == again
    by = defaultdict(lambda: [0, 0, 0.0])
    source = {r.doc_id: r.source for r in docs.collect()}
    for k, size, total, target, copies, taken in first:
        x = by[source[k]]
        x[0], x[1], x[2] = x[0] + taken, total, target
        assert taken == copies * size <= 3 * size
    for taken, total, target in by.values():
        assert abs(taken - target) <= 50 and target <= 3 * total + 1e-6
    assert sum(x[2] for x in by.values()) == pytest.approx(sum(x[1] for x in by.values()))


def test_targets_stop_at_three_times_their_source(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 2), ("d", 500), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["b"] == 3 and got["c"] == 6 and got[None] == 0
    assert got["a"] == pytest.approx(297) and got["d"] == pytest.approx(297)


def test_mixed_documents_repeat(odd):
    copies = {r.doc_id: r.copies for r in mixing.mix(odd).collect()}
    times = Counter(k for k, _ in data())
    got = Counter(r.doc_id for r in mixing.mixed_documents(odd).collect())
    assert got == Counter({k: n * copies[k] for k, n in times.items() if n * copies[k]})


def test_mixing_plan_has_no_python(spark):
    assert not re.search("Python|Pandas|MapInArrow", mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString())


def _kept(df):
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def test_line_dedup_of_odd_documents(odd, empty):
    got = _kept(linededup.dedup_lines(odd))
    _same(got.distinct(), linededup.SQL.replace("FROM documents)", "FROM (SELECT DISTINCT * FROM documents))"), rows())
    assert got.count() == len(rows())
    assert linededup.dedup_lines(empty).collect() == []


def test_line_dedup_by_hand(spark):
    texts = [(3, "Shared  line\nshared  LINE \nown"), (1, "\tSHARED  line\nshort\nother"), (2, "short\n\n\nshared  line"), (4, "alone alone\nalone alone")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: (3, 0, texts[1][1]), 2: (4, 1, "short\n\n"), 3: (3, 2, "own"), 4: (2, 0, texts[3][1])}
    three = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(docs, min_docs=4).collect()}
    assert set(three.values()) == {0}


def test_deduped_documents_keep_their_columns(odd):
    out = linededup.deduped_documents(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert all(r.n_chars == len(r.text) for r in out.collect())


@pytest.mark.parametrize("name", ["op4_warc", "op9_mixing", "op10_line_dedup"])
def test_queries_match_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = c.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = Q.queries()[name](spark, SF)
    cols = sorted(names)
    assert cols == sorted(got.columns)
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    flat = lambda r: tuple(r[c] for c in cols)
    assert sorted(map(flat, (r.asDict() for r in got.collect())), key=str) == sorted(map(flat, want), key=str)
