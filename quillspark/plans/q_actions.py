"""Queries on findings, wrapping, patches, decisions, reports, markup and whole actions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import positions
from ..operators import chunks, cmark, findings, patch, reflow, report, rustlex, tokens
from ..tables import pieces
from . import api
from .q_positions import D, L, docs
from .q_words import TOK, forms, placed_words, word_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Findings: words of at least 9 characters by one detector, and by another those of at least 11, two columns further on.
_FOUND = f"""{L}, {TOK[len(D) + 2:]},
w AS (SELECT tok.doc_id, tok_idx, word, l.line_no, (tok.start_off - l.start_off)::INT AS col FROM tok JOIN l ON l.doc_id = tok.doc_id AND tok.start_off >= l.start_off AND tok.start_off < l.start_off + length(l.line) WHERE length(word) >= 9),
f AS (SELECT doc_id, 'hunspell' AS detector, 1 AS rank, line_no AS start_line, col AS start_col, line_no AS end_line, (col + length(word) - 1)::INT AS end_col, word FROM w
      UNION ALL SELECT doc_id, 'nlprules', 4, line_no, col + 2, line_no, (col + length(word) + 1)::INT, word FROM w WHERE length(word) >= 11
      UNION ALL SELECT doc_id, 'zspell', 2, line_no, col, line_no, (col + length(word) - 1)::INT, word FROM w WHERE length(word) = 10)"""


def _found(spark, sf_dir):
    both = placed_words(spark, sf_dir, 9)
    n = F.char_length("word")
    kinds = F.array(F.struct(F.lit("hunspell").alias("detector"), F.lit(0).alias("shift")), F.when(n == 10, F.struct(F.lit("zspell").alias("detector"), F.lit(0).alias("shift"))), F.when(n >= 11, F.struct(F.lit("nlprules").alias("detector"), F.lit(2).alias("shift"))))
    out = both.withColumn("k", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    col = (F.col("col") + F.col("k.shift")).cast("int")
    return out.select("doc_id", F.col("k.detector").alias("detector"), F.col("line_no").alias("start_line"), col.alias("start_col"), F.col("line_no").alias("end_line"), (col + n - 1).cast("int").alias("end_col"), "word")


def _dealt_found(spark, sf_dir):
    """Findings dealt by document for windows, so that what a task sorts is the same whatever there is in all."""
    return _found(spark, sf_dir).repartition(pieces(docs(spark, sf_dir), 2 << 20), "doc_id")


_COLS = "doc_id, detector, start_line, start_col, end_line, end_col, word"


@query(f"WITH {_FOUND} SELECT DISTINCT {_COLS} FROM f")
def findings_union(spark, sf_dir):
    return findings.union(_found(spark, sf_dir))


@query(f"WITH {_FOUND} SELECT {_COLS}, row_number() OVER (PARTITION BY doc_id ORDER BY start_line, start_col, end_line, end_col, rank)::INT AS nth FROM f")
def findings_sorted(spark, sf_dir):
    from pyspark.sql import Window

    rows = _dealt_found(spark, sf_dir).withColumn("replacements", F.array().cast("array<string>"))
    w = Window.partitionBy("doc_id").orderBy(*findings.in_order("doc_id")[1:])
    return rows.withColumn("nth", F.row_number().over(w)).drop("replacements")


@query(f"""WITH {_FOUND}, o AS (SELECT *, lag(start_line) OVER w AS a, lag(start_col) OVER w AS b, lag(end_line) OVER w AS c, lag(end_col) OVER w AS e FROM f
  WINDOW w AS (PARTITION BY doc_id ORDER BY start_line, start_col, end_line, end_col, rank))
SELECT {_COLS} FROM o WHERE a IS NULL OR end_line < a OR c < start_line OR NOT (CASE WHEN start_line < a OR (start_line = a AND start_col < b) THEN end_col > b ELSE start_col < e END)""")
def overlap_filtered(spark, sf_dir):
    rows = _dealt_found(spark, sf_dir).withColumn("replacements", F.array().cast("array<string>"))
    return findings.without_overlaps(rows, "doc_id").drop("replacements")


@query(f"""WITH {D}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM d),
r AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN '' ELSE list_reduce(ws, lambda a, x: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(x) <= 60 THEN a || ' ' || x ELSE a || chr(10) || x END) END AS t FROM w)
SELECT doc_id, md5(t) AS wrapped_md5, len(string_split(t, chr(10)))::INT AS n_lines FROM r""")
def wrap_lines(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", reflow.wrapped(F.col("text"), 60).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("wrapped_md5"), F.size(F.split("t", "\n")).alias("n_lines"))


@query()
def wrap_unbreakable(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(\p{L}{5}) (\p{L}{5})\b", "[$1 $2](x)"))
    return reflow.reflow(d, 60, ("doc_id",)).groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max("end").alias("last_end"))


@query()
def reflow_paragraphs(spark, sf_dir):
    return reflow.reflow(docs(spark, sf_dir), 80, ("doc_id",)).select("doc_id", "start", "end", F.md5("replacement").alias("replacement_md5"))


@query(f"WITH {D} SELECT doc_id, md5(regexp_replace(text, '([\\p{{L}}\\p{{M}}\\p{{N}}_]{{10,}})', '<\\1>', 'g')) AS text_md5 FROM d")
def patches_apply(spark, sf_dir):
    rows = placed_words(spark, sf_dir, 10)
    patches = rows.select("doc_id", F.col("start_off").alias("start"), (F.col("start_off") + F.char_length("word")).alias("end"), F.concat(F.lit("<"), "word", F.lit(">")).alias("content"))
    return patch.apply(docs(spark, sf_dir), patches).select("doc_id", F.md5("text").alias("text_md5"))


_DECIDED = f"""{TOK}, q AS (SELECT doc_id, tok_idx, word, doc_id::VARCHAR || ':' || tok_idx AS finding_id, [word || 's', reverse(word)] AS replacements FROM tok WHERE length(word) >= 12),
c AS (SELECT *, CASE WHEN @marked THEN '@mark' WHEN tok_idx % 5 = 0 THEN '1' WHEN tok_idx % 5 = 1 THEN 'original' WHEN tok_idx % 5 = 2 THEN '2' WHEN tok_idx % 5 = 3 THEN 'custom' ELSE 'skip' END AS choice FROM q),
o AS (SELECT *, CASE choice WHEN '1' THEN word || 's' WHEN '2' THEN reverse(word) WHEN 'original' THEN '`' || word || '`' WHEN 'custom' THEN 'own' END AS content FROM c)"""


def _decided_sql(mark, marked):
    return _DECIDED.replace("@marked", marked).replace("@mark", mark)


def _decided(spark, sf_dir, mark, marked):
    rows = word_rows(spark, sf_dir).filter(F.char_length("word") >= 12).select("doc_id", "tok_idx", "word", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("tok_idx").cast("string")).alias("finding_id"))
    k = F.col("tok_idx") % 5
    choice = F.when(marked, mark).when(k == 0, "1").when(k == 1, "original").when(k == 2, "2").when(k == 3, "custom").otherwise("skip")
    decisions = rows.select("finding_id", choice.alias("choice"), F.lit("own").alias("custom"))
    found = rows.withColumn("replacements", F.array(F.concat("word", F.lit("s")), F.reverse("word")))
    return patch.decide(found, decisions, ["doc_id", "tok_idx"]).select("doc_id", "tok_idx", "word", "content")


@query(f"""WITH {_decided_sql("quit", "doc_id >= (SELECT max(doc_id) // 2 FROM documents) AND tok_idx % 7 = 3")}, s AS (SELECT min((doc_id, tok_idx)) AS stop FROM o WHERE choice = 'quit')
SELECT doc_id, tok_idx, word, content FROM o, s WHERE content IS NOT NULL AND (stop IS NULL OR (doc_id, tok_idx) < stop)""")
def decisions_quit(spark, sf_dir):
    top = docs(spark, sf_dir).agg(F.max("doc_id")).first()[0] or 0
    return _decided(spark, sf_dir, "quit", (F.col("doc_id") >= top // 2) & (F.col("tok_idx") % 7 == 3))


@query(f"""WITH {_decided_sql("skip_file", "tok_idx % 13 = 12")}, s AS (SELECT doc_id, min(tok_idx) AS stop FROM o WHERE choice = 'skip_file' GROUP BY doc_id)
SELECT o.doc_id, tok_idx, word, content FROM o LEFT JOIN s ON s.doc_id = o.doc_id WHERE content IS NOT NULL AND (stop IS NULL OR tok_idx < stop)""")
def decisions_skip_file(spark, sf_dir):
    return _decided(spark, sf_dir, "skip_file", F.col("tok_idx") % 13 == 12)


@query(f"""WITH {_decided_sql("abort", "tok_idx % 11 = 6")} SELECT doc_id, tok_idx, word, content FROM o WHERE content IS NOT NULL AND (SELECT count(*) FROM o WHERE choice = 'abort') = 0""")
def decisions_abort(spark, sf_dir):
    return _decided(spark, sf_dir, "abort", F.col("tok_idx") % 11 == 6)


@query("""WITH r AS (SELECT doc_id, list_transform(range(0, doc_id % 10), lambda i: 'r' || i) AS r FROM documents)
SELECT doc_id, CASE len(r) WHEN 0 THEN '' WHEN 1 THEN ' - ' || r[1] WHEN 2 THEN ' - ' || r[1] || ' or ' || r[2]
  ELSE CASE WHEN len(r) <= 7 THEN ' - ' || array_to_string(r[:len(r) - 1], ', ') || ', or ' || r[-1] ELSE ' - ' || array_to_string(r[:7], ', ') || ', or one of ' || (len(r) - 7) || ' others' END END AS shown FROM r""")
def render_replacements(spark, sf_dir):
    n = (F.col("doc_id") % 10).cast("int")
    r = F.transform(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: i < n), lambda i: F.concat(F.lit("r"), i.cast("string")))
    return docs(spark, sf_dir).select("doc_id", report.replacements_text(r).alias("shown"))


def _excerpt_sql(width: str) -> str:
    """Of z (line, s, e): v_ with shown, mark_at, mark_len, in so much room."""
    return f"""a_ AS (SELECT *, length(line)::INT AS n, ({width})::INT AS width FROM z),
m_ AS (SELECT *, CASE WHEN e - s > 20 THEN substring(line, s + 1, 4) || '...' || substring(line, e - 3, 4) ELSE substring(line, s + 1, e - s) END AS mark FROM a_),
b_ AS (SELECT *, greatest(width - length(mark), 0) AS room, n - e AS rgt FROM m_), h_ AS (SELECT *, room // 2 AS half FROM b_),
t_ AS (SELECT *, CASE WHEN s + rgt <= room THEN s WHEN s <= half THEN s WHEN rgt <= half THEN room - rgt ELSE half END AS lt FROM h_),
u_ AS (SELECT *, least(CASE WHEN s + rgt <= room THEN rgt ELSE room - lt END, rgt) AS rt FROM t_),
x_ AS (SELECT *, CASE WHEN lt < s THEN '..' || substring(substring(line, (s - lt + 1)::INT, lt::INT), 3) ELSE substring(line, (s - lt + 1)::INT, lt::INT) END AS l_text,
             CASE WHEN rt < rgt THEN left(substring(line, e + 1, rt::INT), greatest(rt - 2, 0)::INT) || '..' ELSE substring(line, e + 1, rt::INT) END AS r_text FROM u_),
v_ AS (SELECT *, CASE WHEN n <= width THEN line ELSE l_text || mark || r_text END AS shown, (CASE WHEN n <= width THEN s ELSE length(l_text) END)::INT AS mark_at, (CASE WHEN n <= width THEN e - s ELSE length(mark) END)::INT AS mark_len FROM x_)"""


@query(f"""WITH {L}, q AS (SELECT doc_id, line_no, line, ((doc_id * 7 + line_no * 3) % greatest(length(line), 1))::INT AS s FROM l),
z AS (SELECT *, least(s + 5 + (doc_id + line_no) % 30, length(line))::INT AS e FROM q), {_excerpt_sql("50")}
SELECT doc_id, line_no, shown, mark_at, mark_len FROM v_""")
def render_excerpt(spark, sf_dir):
    """An excerpt of every line, around a range made of the document's and the line's number."""
    rows = positions.line_table(docs(spark, sf_dir), "doc_id", "text").select("doc_id", "line_no", "line")
    rows = rows.withColumn("s", ((F.col("doc_id") * 7 + F.col("line_no") * 3) % F.greatest(F.char_length("line"), F.lit(1))).cast("int")).withColumn("e", F.least(F.col("s") + 5 + (F.col("doc_id") + F.col("line_no")) % 30, F.char_length("line")).cast("int"))
    text, at, n = report.excerpt(F.col("line"), F.col("s"), F.col("e"), 50)
    return rows.select("doc_id", "line_no", text.alias("shown"), at.cast("int").alias("mark_at"), n.cast("int").alias("mark_len"))


#: Context on either side of a word; an excerpt of 80 is the same whatever a line has beyond that.
_CONTEXT = 100


def _in_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start_line", "start_col", "word", "before", "after"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    for b in batches:
        rows = []
        for k, text in ((b.column(0)[i].as_py(), b.column(1)[i].as_py()) for i in range(b.num_rows)):
            for no, line in enumerate((text or "").split("\n"), 1):
                for m in tokens._WORD.finditer(line):
                    if m.end() - m.start() >= 9:
                        rows.append((k, no, m.start(), m[0], line[max(m.start() - _CONTEXT, 0) : m.start()], line[m.end() : m.end() + _CONTEXT]))
                        if len(rows) == 20_000:  # a batch of long texts goes on in parts
                            yield made(rows)
                            rows = []
        if rows:
            yield made(rows)


@query(f"""WITH {_FOUND}, z AS (SELECT f.doc_id, start_line, start_col, word, l.line, start_col AS s, end_col + 1 AS e, repeat(' ', length(start_line::VARCHAR)) AS pad FROM f JOIN l ON l.doc_id = f.doc_id AND l.line_no = start_line WHERE detector = 'hunspell'),
{_excerpt_sql("80 - length(pad) - 3")}
SELECT doc_id, start_line, start_col, 'error: spellcheck(hunspell)' || chr(10) || pad || '--> doc' || doc_id || ':' || start_line || chr(10) || pad || ' |' || chr(10)
  || start_line || ' | ' || shown || chr(10) || pad || ' | ' || repeat(' ', mark_at) || repeat('^', mark_len) || ' - ' || word || 's' || chr(10) || pad || ' |' AS block FROM v_""")
def render_findings(spark, sf_dir):
    """All findings of each document, words of any length, each with its own line."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.mapInArrow(_in_context, "doc_id long, start_line int, start_col int, word string, before string, after string")
    start = F.char_length("before")
    block = report.render(F.lit("hunspell"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("start_line"), F.concat("before", "word", "after"), start, start + F.char_length("word"), F.array(F.concat("word", F.lit("s"))), F.lit(None).cast("string"))
    return rows.select("doc_id", "start_line", "start_col", block.alias("block"))


@query()
def erase_markup_docs(spark, sf_dir):
    rows = cmark.plain_chunks(docs(spark, sf_dir), ("doc_id",))
    return rows.select("doc_id", F.char_length("plain").alias("n_plain"), F.size("plain_map").alias("n_map"), F.md5("plain").alias("plain_md5"))


@query()
def erase_markup_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("text"))
    return cmark.plain_chunks(pages, ("page_id",)).select("page_id", F.char_length("plain").alias("n_plain"), F.size("plain_map").alias("n_map"))


@query("SELECT page_id, md5(regexp_replace(coalesce(html, ''), '<[^<>]*>', '', 'g')) AS text_md5 FROM pages")
def html_tag_strip(spark, sf_dir):
    """Tags out by an expression: an approximation for tables of pages, not the erasure of markup."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.md5(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^<>]*>", "")).alias("text_md5"))


def _sources(spark, sf_dir):
    """A Rust source made of each document: lines become comments of several kinds."""
    lines = F.split(F.regexp_replace("text", r"\*/|/\*", ""), "\n")
    made = F.transform(lines, lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("struct X"), i.cast("string"), F.lit(";"))).when(i % 5 == 3, F.concat(F.lit("/* "), x, F.lit(" */"))).when(i % 5 == 2, F.concat(F.lit("// "), x)).otherwise(F.concat(F.lit("/// "), x)))
    return docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("origin_id"), F.lit("rust").alias("kind"), F.lit(None).cast("string").alias("path"), F.array_join(made, "\n").alias("content"))


@query(f"""WITH {L}, k AS (SELECT doc_id, line_no, line, CASE (line_no - 1) % 5 WHEN 4 THEN NULL WHEN 3 THEN 'SlashStar' WHEN 2 THEN 'DoubleSlash' ELSE 'TripleSlash' END AS tag FROM (SELECT doc_id, line_no, replace(replace(line, '*/', ''), '/*', '') AS line FROM l))
SELECT doc_id::VARCHAR AS origin_id, tag, line_no AS start_line, CASE tag WHEN 'TripleSlash' THEN 3 ELSE 2 END::INT AS start_col, md5(CASE tag WHEN 'SlashStar' THEN ' ' || line || ' ' ELSE ' ' || line END) AS text_md5 FROM k WHERE tag IS NOT NULL""")
def rust_extract(spark, sf_dir):
    rows = rustlex.extract(_sources(spark, sf_dir), True, True)
    return rows.select("origin_id", F.col("variant.tag").alias("tag"), F.col("span.start.line").alias("start_line"), F.col("span.start.col").alias("start_col"), F.md5("text").alias("text_md5"))


@query(f"""WITH {L}, k AS (SELECT doc_id, line_no, CASE (line_no - 1) % 5 WHEN 4 THEN NULL WHEN 3 THEN 'B' WHEN 2 THEN 'Dev' ELSE 'Doc' END AS c FROM l),
g AS (SELECT *, CASE WHEN c <> 'B' AND c = lag(c) OVER w AND line_no = lag(line_no) OVER w + 1 THEN 0 ELSE 1 END AS new FROM k WHERE c IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id::VARCHAR AS origin_id, sum(new)::BIGINT AS n_chunks, count(*)::BIGINT AS n_fragments FROM g GROUP BY doc_id""")
def rust_chunks(spark, sf_dir):
    rows = chunks.chunks(rustlex.extract(_sources(spark, sf_dir), True, True))
    return rows.groupBy("origin_id").agg(F.count("*").alias("n_chunks"), F.sum(F.size("source_mapping")).cast("long").alias("n_fragments"))


@query()
def check_action(spark, sf_dir):
    """Spelling with suggestions and grammar over all turns of conversations, as Markdown."""
    from ..sources import readers
    from .config import Config, masked

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    found = api.check(readers.from_rows(rows, "id", "text"), api.Context(forms(spark, sf_dir), config=masked(Config(), "hunspell,nlprules")))
    return found.select("origin_id", "detector", "start_line", "start_col", "end_line", "end_col", "word", F.array_join("replacements", ",").alias("replacements"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def events_by_window(spark, sf_dir):
    from ..streaming import incremental

    return incremental.counts_by_window(spark.read.parquet(f"{sf_dir}/events.parquet")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query()
def reflow_applied(spark, sf_dir):
    """Comments of sources made of the documents, wrapped in place."""
    return api.rewrapped(_sources(spark, sf_dir)).select("origin_id", F.md5("content").alias("content_md5"))


@query()
def dummy_checker(spark, sf_dir):
    from ..sources import readers

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    ctx = api.Context(forms(spark, sf_dir), config=api.Config(hunspell=None), more={"dummy": api.dummy})
    return api.check(readers.from_rows(rows, "id", "text"), ctx).groupBy("origin_id").agg(F.count("*").alias("n_findings"))
