"""Queries on lines, ranges, spans, comments and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import comments, positions
from ..operators import chunks
from ..tables import cut, pieces, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


D = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
L = f"""{D},
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM d),
l AS (SELECT doc_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_off FROM x)"""
T = f"""{L},
t AS (SELECT * FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM l) WHERE line <> '' OR line_no < last),
r AS (SELECT doc_id, (doc_id * 37 % greatest(length(text), 1))::INT AS s, (doc_id * 37 % greatest(length(text), 1))::INT + 120 AS e FROM d)"""


@query(f"WITH {L} SELECT doc_id, line_no, start_off, length(line)::INT AS n_chars, md5(line) AS line_md5 FROM l")
def doc_lines(spark, sf_dir):
    t = positions.line_table(docs(spark, sf_dir))
    return t.select("doc_id", "line_no", "start_off", F.char_length("line").cast("int").alias("n_chars"), F.md5("line").alias("line_md5"))


@query(f"""WITH {D},
m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN chr(13) || chr(10) || chr(13) || chr(10) ELSE '' END
             || replace(text, chr(10), CASE doc_id % 5 WHEN 1 THEN chr(13) || chr(10) WHEN 2 THEN chr(13) WHEN 3 THEN chr(10) || chr(13) ELSE chr(10) END) AS t FROM d),
c AS (SELECT doc_id, t, d, length(d) AS size, (length(t) - length(replace(t, d, ''))) // length(d) AS n, instr(t, d) AS seen
      FROM m, (VALUES (chr(13)), (chr(10)), (chr(13) || chr(10)), (chr(10) || chr(13))) v(d)),
p AS (SELECT doc_id, max(CASE WHEN size = 2 THEN n END) AS pairs FROM c GROUP BY doc_id),
k AS (SELECT c.doc_id, d, size, seen, CASE WHEN size = 1 THEN n - pairs ELSE n END AS n FROM c JOIN p USING (doc_id)),
o AS (SELECT doc_id, d, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen, size DESC) AS rn FROM k WHERE n > 0)
SELECT d.doc_id, hex(o.d) AS delimiter FROM d LEFT JOIN o ON o.doc_id = d.doc_id AND rn = 1""")
def dominant_delimiter(spark, sf_dir):
    new = F.when(F.col("doc_id") % 5 == 1, "\r\n").when(F.col("doc_id") % 5 == 2, "\r").when(F.col("doc_id") % 5 == 3, "\n\r").otherwise("\n")
    mixed = F.concat(F.when(F.col("doc_id") % 7 == 0, "\r\n\r\n").otherwise(""), F.replace(F.col("text"), F.lit("\n"), new))
    return docs(spark, sf_dir).select("doc_id", mixed.alias("t")).select("doc_id", F.hex(positions.dominant_delimiter(F.col("t"))).alias("delimiter"))


@query(f"""WITH {D}, n AS (SELECT *, length(text)::INT AS n, (doc_id % 50)::INT AS a FROM d)
SELECT doc_id, CASE WHEN a < n THEN substring(text, a + 1, 20) ELSE '' END AS inside,
       CASE WHEN n >= 5 THEN substring(text, n - 4, 10) ELSE '' END AS beyond, '' AS outside FROM n""")
def char_substring(spark, sf_dir):
    n, a = F.char_length("text"), (F.col("doc_id") % 50).cast("int")
    text = F.col("text")
    return docs(spark, sf_dir).select("doc_id", positions.sub_chars(text, a, a + 20).alias("inside"), positions.sub_chars(text, n - 5, n + 5).alias("beyond"), positions.sub_chars(text, n + 1, n + 3).alias("outside"))


@query(f"""WITH {D}, p AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS parts FROM d WHERE text <> '')
SELECT doc_id, length(text)::INT AS range_end, len(parts)::INT AS end_line, greatest(length(parts[-1]) - 1, 0)::INT AS end_col FROM p""")
def markdown_chunk_mapping(spark, sf_dir):
    rows = chunks.markdown_chunks(docs(spark, sf_dir).select(F.col("doc_id").alias("origin_id"), F.col("text").alias("content")))
    m = F.get("source_mapping", F.lit(0))
    return rows.select(F.col("origin_id").alias("doc_id"), m["range"]["end"].alias("range_end"), m["span"]["end"]["line"].alias("end_line"), m["span"]["end"]["col"].alias("end_col"))


def _ranges(spark, sf_dir):
    s = (F.col("doc_id") * 37 % F.greatest(F.char_length("text"), F.lit(1))).cast("int")
    return docs(spark, sf_dir).select(F.col("doc_id").alias("r_id"), s.alias("s0"), (s + 120).alias("e0"))


def _lines_with_ranges(spark, sf_dir):
    lines = positions.text_lines(docs(spark, sf_dir))
    return lines.join(_ranges(spark, sf_dir), F.col("doc_id") == F.col("r_id")).drop("r_id")


@query(f"""WITH {T} SELECT doc_id, line_no, start_off AS l_start, (start_off + length(line))::INT AS l_end
FROM t JOIN r USING (doc_id) WHERE start_off + length(line) >= s AND (start_off < e OR line_no = 1)""")
def covered_lines(spark, sf_dir):
    rows = positions.covered_lines(_lines_with_ranges(spark, sf_dir), F.col("s0"), F.col("e0"))
    return rows.select("doc_id", "line_no", F.col("l_start").cast("int").alias("l_start"), F.col("l_end").cast("int").alias("l_end"))


def _fragments(rows):
    """Each line as a fragment, in an origin where it is indented."""
    return rows.withColumn("f_start", F.col("start_off")).withColumn("f_end", F.col("start_off") + F.char_length("line")).withColumn("col", (F.col("doc_id") % 5).cast("int")).withColumn("line", F.col("line_no"))


@query(f"""WITH {T}, c AS (SELECT doc_id, line_no AS line, start_off, greatest(start_off, r.s) AS s, least(start_off + length(line), r.e) AS e FROM t JOIN r USING (doc_id))
SELECT doc_id, s::INT AS s, e::INT AS e, line, (doc_id % 5 + s - start_off)::INT AS c0, (doc_id % 5 + e - start_off - 1)::INT AS c1 FROM c WHERE s < e""")
def range_to_span(spark, sf_dir):
    rows = positions.find_spans(_fragments(_lines_with_ranges(spark, sf_dir)), F.col("s0"), F.col("e0"))
    return rows.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("s", "e", "line", "c0", "c1")])


@query(f"""WITH {T} SELECT doc_id, line_no, start_off AS f_start, (start_off + length(line))::INT AS f_end
FROM t JOIN r USING (doc_id) WHERE start_off + length(line) > s AND start_off <= e AND length(line) > 0""")
def covered_spans(spark, sf_dir):
    rows = positions.find_covered_spans(_fragments(_lines_with_ranges(spark, sf_dir)), F.col("s0"), F.col("e0"))
    return rows.select("doc_id", "line_no", F.col("f_start").cast("int").alias("f_start"), F.col("f_end").cast("int").alias("f_end"))


@query(f"""WITH {D}, b AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n, (doc_id * 7919 % (strlen(text) + 5))::BIGINT AS s FROM d),
e AS (SELECT *, least(s + 1 + doc_id % 90, n) AS e FROM b)
SELECT doc_id, CASE WHEN s < n THEN length(regexp_replace(regexp_replace(substr(h, 1, 2 * (s + 1)), '(.).', '\\1', 'g'), '[89AB]', '', 'g')) - 1 END::INT AS c_start,
       CASE WHEN s < n THEN length(regexp_replace(regexp_replace(substr(h, 1, 2 * e), '(.).', '\\1', 'g'), '[89AB]', '', 'g')) END::INT AS c_end FROM e""")
def byte_ranges(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("s", (F.col("doc_id") * 7919 % (F.octet_length("text") + 5)).cast("int"))
    r = positions.byte_range_to_chars(F.col("text"), F.col("s"), (F.col("s") + 1 + F.col("doc_id") % 90).cast("int"))
    return rows.select("doc_id", r["start"].alias("c_start"), r["end"].alias("c_end"))


@query(f"""WITH {D}, o AS (SELECT doc_id, text, (doc_id * 7919 % (length(text) + 3))::INT AS k FROM d), p AS (SELECT *, substring(text, 1, k) AS b FROM o)
SELECT doc_id, CASE WHEN k < length(text) THEN length(b) - length(replace(b, chr(10), '')) + 1 END::INT AS line, CASE WHEN k < length(text) THEN length(string_split(b, chr(10))[-1]) END::INT AS col FROM p""")
def char_places(spark, sf_dir):
    at = (F.col("doc_id") * 7919 % (F.char_length("text") + 3)).cast("int")
    return docs(spark, sf_dir).select("doc_id", positions.place_of(F.col("text"), at).alias("p")).select("doc_id", "p.line", "p.col")


@query("""WITH s AS (SELECT doc_id, (1 + doc_id % 4)::INT AS l0, (doc_id % 9)::INT AS c0, (1 + doc_id % 4 + doc_id % 3 // 2)::INT AS l1, (doc_id % 9 + doc_id % 13)::INT AS c1 FROM documents)
SELECT doc_id, CASE WHEN l0 = l1 THEN c1 + 1 - c0 END::INT AS n, l0 <= 3 AND 3 <= l1 AS covers, CASE WHEN l0 = l1 AND l0 = 2 AND c0 >= 3 AND c1 <= 12 THEN c0 - 3 END::INT AS inner_start,
       CASE WHEN l0 = l1 AND l0 = 2 AND c0 >= 3 AND c1 <= 12 THEN c1 - 2 END::INT AS inner_end, greatest(c0 - 4, 0)::INT AS shifted, CASE WHEN c1 >= 2 THEN l1 ELSE l1 - 1 END::INT AS trimmed_line, CASE WHEN c1 >= 2 THEN c1 - 2 ELSE 0 END::INT AS trimmed_col FROM s""")
def span_arithmetic(spark, sf_dir):
    k = F.col("doc_id")
    l0, c0 = (k % 4 + 1).cast("int"), (k % 9).cast("int")
    s = positions.span(l0, c0, l0 + F.floor(k % 3 / 2).cast("int"), c0 + (k % 13).cast("int"))
    inner = positions.relative_to(s, positions.span(*map(F.lit, (2, 3, 2, 12))))
    trimmed = comments.trim_span(s, F.lit(3), F.lit(2))["end"]
    moved = positions.shifted(F.struct(s["start"]["col"].alias("start"), s["end"]["col"].alias("end")), F.lit(-4))
    return docs(spark, sf_dir).select(
        "doc_id", positions.one_line_len(s).cast("int").alias("n"), positions.covers_line(s, F.lit(3)).alias("covers"), inner["start"].cast("int").alias("inner_start"), inner["end"].cast("int").alias("inner_end"),
        moved["start"].alias("shifted"), trimmed["line"].cast("int").alias("trimmed_line"), trimmed["col"].cast("int").alias("trimmed_col"),
    )


@query(f"""WITH {T} SELECT doc_id, (start_off + 2)::INT AS s, (start_off + 7)::INT AS e FROM t WHERE line_no = 1 + doc_id % 3 AND length(line) > 6""")
def span_to_range(spark, sf_dir):
    frags = _fragments(positions.text_lines(docs(spark, sf_dir)))
    rows = positions.to_content_range(frags, F.col("doc_id") % 3 + 1, F.col("doc_id") % 5 + 2, F.col("doc_id") % 5 + 6)
    return rows.select("doc_id", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))


@query(f"WITH {T} SELECT doc_id, line_no, (doc_id % 5 + length(line))::INT AS line_length FROM t")
def line_lengths(spark, sf_dir):
    rows = positions.text_lines(docs(spark, sf_dir))
    return rows.select("doc_id", "line_no", (F.col("doc_id") % 5 + F.char_length("line")).cast("int").alias("line_length"))


@query("""WITH v AS (SELECT t AS tag, (i - 1)::INT AS at FROM (SELECT unnest(['TripleSlash','DoubleSlashEM','MacroDocEqStr','MacroDocEqMacro','SlashAsteriskEM','SlashAsteriskAsterisk','CommonMark','TomlEntry','DoubleSlash','SlashStar','SlashAsterisk','Unknown']) AS t, generate_subscripts(range(12), 1) AS i)),
a AS (SELECT tag, h::INT AS hashes FROM v, range(0, 4) r(h))
SELECT tag, hashes,
  CASE tag WHEN 'TripleSlash' THEN '///' WHEN 'DoubleSlashEM' THEN '//!' WHEN 'DoubleSlash' THEN '//' WHEN 'SlashStar' THEN '/*' WHEN 'SlashAsterisk' THEN '/*' WHEN 'SlashAsteriskEM' THEN '/*!' WHEN 'SlashAsteriskAsterisk' THEN '/**'
    WHEN 'MacroDocEqStr' THEN '#[doc=' || CASE WHEN hashes = 0 THEN '"' ELSE 'r' || repeat('#', hashes - 1) || '"' END ELSE '' END AS prefix,
  CASE WHEN tag = 'MacroDocEqStr' THEN CASE WHEN hashes <= 1 THEN '"]' ELSE '"' || repeat('#', hashes - 1) || ']' END WHEN tag IN ('SlashAsterisk','SlashAsteriskEM','SlashAsteriskAsterisk') THEN '*/' ELSE '' END AS suffix,
  CASE tag WHEN 'TripleSlash' THEN 3 WHEN 'DoubleSlashEM' THEN 3 WHEN 'DoubleSlash' THEN 2 WHEN 'SlashStar' THEN 2 WHEN 'SlashAsterisk' THEN 2 WHEN 'SlashAsteriskEM' THEN 3 WHEN 'SlashAsteriskAsterisk' THEN 3 WHEN 'MacroDocEqStr' THEN 6 + hashes + 1 ELSE 0 END::INT AS prefix_len,
  CASE WHEN tag = 'MacroDocEqStr' THEN CASE hashes WHEN 0 THEN 2 ELSE hashes + 1 END WHEN tag IN ('SlashAsterisk','SlashAsteriskEM','SlashAsteriskAsterisk') THEN 2 ELSE 0 END::INT AS suffix_len
FROM a""")
def variant_affixes(spark, sf_dir):
    rows = spark.createDataFrame([(t, h) for t in comments.VARIANTS for h in range(4)], "tag string, hashes int")
    tag, p, h = F.col("tag"), F.lit("#[doc="), F.col("hashes")
    return rows.select("tag", "hashes", comments.prefix(tag, p, h).alias("prefix"), comments.suffix(tag, h).alias("suffix"), comments.prefix_len(tag, p, h).alias("prefix_len"), comments.suffix_len(tag, h).alias("suffix_len"))


@query(f"""WITH {T}, v AS (SELECT doc_id, ['TripleSlash','DoubleSlashEM','MacroDocEqStr','MacroDocEqMacro','SlashAsteriskEM','SlashAsteriskAsterisk','CommonMark','TomlEntry','DoubleSlash','SlashStar','SlashAsterisk','Unknown'][line_no % 12 + 1] AS tag, line FROM t),
c AS (SELECT doc_id, CASE WHEN tag = 'CommonMark' THEN 'CommonMark' WHEN tag = 'TomlEntry' THEN 'Unmergable' WHEN tag IN ('DoubleSlash','SlashStar','SlashAsterisk','Unknown') THEN 'Dev' ELSE 'Doc' END AS category, line FROM v)
SELECT doc_id, category, count(*)::BIGINT AS n_lines, sum(length(line))::BIGINT AS n_chars FROM c GROUP BY ALL""")
def comment_category(spark, sf_dir):
    tags = F.array(*map(F.lit, comments.VARIANTS))
    rows = positions.text_lines(docs(spark, sf_dir)).withColumn("category", comments.category(F.get(tags, F.col("line_no") % 12)))
    return rows.groupBy("doc_id", "category").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).cast("long").alias("n_chars"))


@query(f"""WITH {T}, s AS (SELECT doc_id, CASE line_no % 6 WHEN 0 THEN '// ' || line WHEN 1 THEN '/// ' || line WHEN 2 THEN '//! ' || line WHEN 3 THEN '/* ' || line || ' */' WHEN 4 THEN '//| ' || line ELSE line END AS c FROM t),
k AS (SELECT doc_id, CASE WHEN regexp_matches(c, '^/\\*(?s:.*)\\*/$') THEN 'block' WHEN regexp_matches(c, '^//([^/|!]|$)') THEN 'line' ELSE 'other' END AS kind FROM s)
SELECT doc_id, kind, count(*)::BIGINT AS n FROM k GROUP BY ALL""")
def dev_line_comments(spark, sf_dir):
    k, line = F.col("line_no") % 6, F.col("line")
    c = F.when(k == 0, F.concat(F.lit("// "), line)).when(k == 1, F.concat(F.lit("/// "), line)).when(k == 2, F.concat(F.lit("//! "), line))
    c = c.when(k == 3, F.concat(F.lit("/* "), line, F.lit(" */"))).when(k == 4, F.concat(F.lit("//| "), line)).otherwise(line)
    return positions.text_lines(docs(spark, sf_dir)).select("doc_id", comments.kind_of_line(c).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


_TURNS = """t AS (SELECT conv_id, turn, coalesce(text, '') AS text, CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN 'Dev' ELSE 'Doc' END AS category FROM conversations),
f AS (SELECT *, CASE WHEN category = lag(category) OVER w AND turn = lag(turn) OVER w + 1 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT *, (sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk_idx FROM f)"""


def _literals(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("category", F.when(F.char_length("text") % 3 == 0, "Dev").otherwise("Doc")).withColumn("start_line", F.col("turn")).withColumn("end_line", F.col("turn"))
    return chunks.islands(rows, "conv_id")


@query(f"WITH {_TURNS} SELECT conv_id, turn, category, chunk_idx FROM c")
def cluster_adjacent(spark, sf_dir):
    return _literals(spark, sf_dir).select("conv_id", "turn", "category", "chunk_idx")


@query(f"""WITH {_TURNS} SELECT conv_id, chunk_idx, string_agg(text, chr(10) ORDER BY turn) AS text, count(*)::INT AS n_parts, length(first(text ORDER BY turn))::INT AS first_end,
(sum(length(text) + 1) - length(last(text ORDER BY turn)) - 1)::INT AS last_start FROM c GROUP BY ALL""")
def render_chunks(spark, sf_dir):
    rows = chunks.render(_literals(spark, sf_dir).drop("category"), "conv_id")
    n = F.size("ranges")
    return rows.select("conv_id", "chunk_idx", "text", n.cast("int").alias("n_parts"), F.get("ranges", F.lit(0))["end"].alias("first_end"), F.get("ranges", n - 1)["start"].alias("last_start"))


@query("""WITH o AS (SELECT 'documents/' || source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.rs' ELSE '.txt' END AS path FROM documents)
SELECT path, CASE WHEN path LIKE '%.md' THEN 'cmark' ELSE 'rust' END AS kind FROM o WHERE path NOT LIKE '%.txt'""")
def list_origins(spark, sf_dir):
    from ..sources import readers

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    end = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".rs").otherwise(".txt")
    rows = d.select(F.concat(F.lit("documents/"), "source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"))
    return rows.withColumn("kind", readers.kind_of_path(F.col("path"))).filter("kind is not null")


@query("""WITH o AS (SELECT CASE WHEN doc_id % 5 = 0 THEN md5(coalesce(text, '')) ELSE (doc_id // 4)::VARCHAR END AS id, coalesce(text, '') AS content FROM documents),
g AS (SELECT id, count(DISTINCT content) AS n FROM o GROUP BY id)
SELECT DISTINCT CASE WHEN n > 1 THEN id || '#' || md5(content) ELSE id END AS origin, content FROM o JOIN g USING (id)""")
def dedupe_origins(spark, sf_dir):
    """Ids of which some are a text's own and others those of up to four texts, equal or not."""
    from ..sources import readers

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = F.when(F.col("doc_id") % 5 == 0, F.md5(F.coalesce("text", F.lit("")))).otherwise(F.floor(F.col("doc_id") / 4).cast("string"))
    return readers.from_rows(d.withColumn("id", own), "id", "text").select(F.col("origin_id").alias("origin"), "content")


_MODULES = """f AS (SELECT DISTINCT doc_id AS id FROM documents),
m AS (SELECT id AS parent, unnest([2 * id + 1, 2 * id + 2, -1]) AS child FROM f),
g AS (SELECT parent, child FROM m JOIN f ON f.id = m.child)"""


def _module_files(spark, sf_dir):
    """A source for each document, which declares those of twice its number."""
    k = F.col("doc_id")
    name = lambda x: F.concat(F.lit("mod d"), x.cast("string"), F.lit(";"))
    content = F.concat_ws("\n", F.lit("//! mod d0;"), name(2 * k + 1), F.concat(F.lit("mod inner { pub "), name(2 * k + 2), F.lit(" }")), F.lit("mod gone;"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    rows = rows.repartition(pieces(rows, 4 << 20), "doc_id").distinct()
    return rows.select(F.concat(F.lit("src/d"), k.cast("string"), F.lit(".rs")).alias("path"), content.alias("content"))


@query(f"WITH {_MODULES} SELECT 'src/d' || parent || '.rs' AS parent, 'src/d' || child || '.rs' AS child FROM g")
def module_files(spark, sf_dir):
    from ..sources import modules

    files = _module_files(spark, sf_dir)
    return modules.resolved(modules.declared(files), files).select("parent", "child")


@query(f"""WITH RECURSIVE {_MODULES}, c(id, depth) AS (SELECT id, 0 FROM f WHERE id NOT IN (SELECT child FROM g) UNION ALL SELECT child, depth + 1 FROM c JOIN g ON g.parent = c.id)
SELECT 'src/d' || id || '.rs' AS path, min(depth)::INT AS depth FROM c GROUP BY ALL""")
def module_closure(spark, sf_dir):
    from ..sources import modules

    files = _module_files(spark, sf_dir)
    edges = cut(modules.resolved(modules.declared(files), files), "edges")
    return modules.closure(files.join(edges.select(F.col("child").alias("path")).hint("merge"), "path", "left_anti"), edges)
