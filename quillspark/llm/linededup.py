"""Line dedup: explode normalised lines, hash, count documents a hash, drop, reassemble by position.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. A key of at least
min_chars code points that is found in at least min_docs documents loses all its lines, except those in the document
with the smallest id that has it. Keys are compared by two chained 64-bit hashes.

Lines are split, normalised and hashed once; what both next steps need of them, hashes and places, is a table. A key's
documents are counted by map-side partial aggregation, so a line that a third of all documents share costs one row for
each map task. Texts move once, to meet the positions that go.

Defined cases: null and empty texts are one empty line; rows that repeat an id are the same document; null ids are
together one document, after all others (the id 2^63-1 stands for it, and is that document where it occurs); a repeated
line inside one document alone stays; ids that are no numbers are an error, as the least of them is asked for. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, cut

LAST = (1 << 63) - 1


def _key(line: F.Column) -> F.Column:
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, version (hash of the text), position and both hashes of each key that is long enough."""
    rows = docs.select("id", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # a key is no longer than its line: short lines go before the costly steps
    rows = rows.filter(F.char_length("line") >= min_chars).select("id", "version", "pos", _key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return rows.select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def _repeated(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, first: the keys of at least min_docs documents and the smallest id of each."""
    if min_docs <= 2:
        return lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").drop("last")
    return lines.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter(F.col("n") >= min_docs).drop("n")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, carry columns, n_lines, n_dropped and kept (the text of the lines that stay) for each row of docs."""
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("__id"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(carry)]
    ).withColumn("version", F.xxhash64("text"))
    lines = cut(_lines(base, min_chars), "line-hashes")
    # the repeated keys are cut off as a table: then a key of very many lines is one that the join may split, or a small table that it broadcasts
    gone = lines.join(cut(_repeated(lines, min_docs), "line-keys"), ["h1", "h2"]).filter("id <> first")
    # by document and text: rows that repeat both share one list
    gone = gone.groupBy("id", "version").agg(F.collect_set("pos").alias("gone"))
    out = base.join(gone, ["id", "version"], "left")
    parts = F.split("text", "\n")
    n = F.size(parts)
    stay = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")), lambda i: F.get(parts, i))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return out.select(
        F.col("__id").alias(id_col), *[F.col(f"__{k}").alias(c) for k, c in enumerate(carry)], n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")
    )


def deduped_documents(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with the lines that stay as text and their length as n_chars; the columns of docs."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = dedup_lines(docs, min_chars, min_docs, carry=rest).withColumnRenamed("kept", "text").withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


SQL = r"""
WITH l AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS id, coalesce(text, '') AS text, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts
  FROM documents),
x AS (SELECT id, doc_id, text, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM l),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
r AS (SELECT key, min(id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT id) >= 2),
j AS (SELECT k.*, r.first IS NOT NULL AND r.first <> k.id AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY id, doc_id, text
"""
