"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

A document has a 60-bit hash of its id. For each source the mix takes whole passes over all its documents and, for
what is left of the target, the documents whose hash lies below a threshold. The threshold is found without a sort:
sizes are summed by source and the first 12 bits of the hash; the bucket where the running sum crosses the budget is
cut by the next 12 bits, and that bucket once more. Each level reads only documents of boundary buckets. Running sums go
over groups of 64 buckets, of which a source has 64 at most, and then within the one group that the budget crosses: no
task has more rows for a hot source than that.

Thresholds are nested: what the first leaves of the budget, less than the document at the boundary, is filled up from
the documents beyond it that are no larger than that rest, by a second threshold, and so on ROUNDS times.

Defined cases: null text has size 0; a null source is a source of its own and comes last; rows with the same id are
taken together; a source of size 0 has target 0 and its documents are taken once if the source is empty of words; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEVELS, BITS, GROUP = 3, 12, 6
ROUNDS = 4
MOST = 3
_ALL = 1 << 60


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size in words and a 60-bit hash of the id."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _size(F.col(text_col)).alias("size"), _hash(F.col(id_col)).alias("h"))


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, target: weights in the order of the sources' code points, null last, and no target above most times its source.

    Sums a source are pre-aggregated; what follows has one row for each source. Handing the excess on until no target is
    above its limit ends where every source has min(limit, weight x level); the level is found from the limits in the
    order of limit / weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = total.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", (F.col("source_size") * most).cast("double"))
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("t"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))).alias("w_left"),
        F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("cap_before"),
    )
    level = (F.col("t") - F.col("cap_before")) / F.col("w_left")
    w = w.withColumn("level", F.max(F.when(level * F.col("w") <= F.col("cap"), level)).over(everything))
    return w.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _bucket(level: int) -> Column:
    """The bits of the hash that level adds."""
    return F.shiftright(F.col("h"), 60 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1).cast("int")


def _crossing(sizes: DataFrame, state: DataFrame) -> DataFrame:
    """source, edge, left: the first 36-bit hash value at which the running size of a source's candidates exceeds left, and what is left before it.

    state: source, left, lowest (of the hash values that are candidates), largest (size). Sources whose candidates all fit have no row.
    """
    edge = state.select(F.col("source").alias("s"), "left", "lowest", "largest", F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        inside = sizes.join(edge, F.col("source").eqNullSafe(F.col("s"))).filter((F.shiftright("h", 60 - LEVELS * BITS) >= F.col("lowest")) & (F.col("size") <= F.col("largest")))
        if level:
            inside = inside.filter(F.shiftright("h", 60 - BITS * level) == F.col("prefix"))
        cells = inside.groupBy("source", "left", "lowest", "largest", "prefix", _bucket(level).alias("b")).agg(F.sum("size").alias("n"))
        groups = cells.groupBy("source", "left", "lowest", "largest", "prefix", F.shiftright("b", GROUP).alias("g")).agg(F.sum("n").alias("n"), F.collect_list(F.struct("b", "n")).alias("cells"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy("g")) - F.col("n")
        over = groups.withColumn("before", before).filter(F.col("before") + F.col("n") > F.col("left"))
        found = over.groupBy("source").agg(F.min(F.struct("g", "before", "left", "lowest", "largest", "prefix", "cells")).alias("x")).select("source", "x.*")
        # along the cells of that group: the sum before the one that crosses, and its number
        along = F.aggregate(
            F.sort_array("cells"),
            F.struct(F.col("before").alias("sum"), F.lit(-1).alias("b")),
            lambda a, c: F.when(a["b"] >= 0, a).when(a["sum"] + c["n"] > F.col("left"), F.struct(a["sum"].alias("sum"), c["b"].alias("b"))).otherwise(F.struct((a["sum"] + c["n"]).alias("sum"), F.lit(-1).alias("b"))),
        )
        found = found.withColumn("at", along)
        edge = cut(found.select(F.col("source").alias("s"), (F.col("left") - F.col("at.sum")).alias("left"), "lowest", "largest", (F.shiftleft("prefix", BITS) + F.col("at.b")).alias("prefix")), "mix-edge")
    return edge.select(F.col("s").alias("source"), F.col("prefix").alias("edge"), "left")


def thresholds(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with passes (whole passes over a source) and cuts: array of (lowest, edge, largest) by round.

    A document is taken once more if a round has lowest <= (h >> 24) < edge and its size is at most largest.
    """
    some = F.col("source_size") > 0
    per = goal.withColumn("passes", F.when(some, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(1).cast("long"))
    # sources without words take part in no round; neither do those at their limit
    open_ = some & (F.col("passes") < MOST)
    state = per.filter(open_).select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("lowest"), F.lit(_ALL).alias("largest"))
    state, done = cut(state, "mix-state"), None
    for _ in range(ROUNDS):
        edge = _crossing(sizes, state).select(F.col("source").alias("s"), "edge", F.col("left").alias("rest"))
        got = cut(state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "lowest", F.coalesce("edge", F.lit(_ALL)).alias("edge"), "largest", "rest"), "mix-round")
        done = got if done is None else done.union(got)
        state = got.filter("rest >= 1").select("source", F.col("rest").alias("left"), F.col("edge").alias("lowest"), F.floor("rest").alias("largest"))
    cuts = done.groupBy(F.col("source").alias("s")).agg(F.collect_list(F.struct("lowest", "edge", "largest")).alias("cuts"))
    return per.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "passes", "cuts")


def _plan(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """A row for each source, as a table: thresholds() of its target."""
    return cut(thresholds(sizes, cut(targets(sizes, weights), "mix-goal")), "mix-per")


def _copies(passes: Column, cuts: Column, size: Column, h: Column) -> Column:
    at = F.shiftright(h, 60 - LEVELS * BITS)
    more = F.exists(cuts, lambda c: (at >= c["lowest"]) & (at < c["edge"]) & (size <= c["largest"]))
    return passes + F.coalesce(more, F.lit(False)).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (copies x size) for each row of docs; the same on each run."""
    sizes = cut(sized(docs, id_col, text_col, source_col), "mix-sizes")
    out = sizes.join(_plan(sizes, weights).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    out = out.withColumn("copies", _copies(F.col("passes"), F.col("cuts"), F.col("size"), F.col("h")))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns of docs.

    Texts are not shuffled: rows meet the plan of their source, a row for each source, and are measured again, which
    costs less than to move them to what was measured before.
    """
    plan = _plan(cut(sized(docs), "mix-sizes"), weights).select(F.col("source").alias("__s"), F.col("passes").alias("__passes"), F.col("cuts").alias("__cuts"))
    out = docs.join(plan, docs["source"].cast("string").eqNullSafe(F.col("__s")))
    out = out.withColumn("__n", _copies(F.col("__passes"), F.col("__cuts"), _size(docs["text"]), _hash(docs["doc_id"]))).filter("__n > 0")
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*[docs[c] for c in docs.columns])


_ROUND = """
c{k} AS (
  SELECT s.source, h, sum(size) AS n, any_value("left") AS "left" FROM sized s JOIN st{k} p ON s.source IS NOT DISTINCT FROM p.source
  WHERE h >= lowest AND size <= largest GROUP BY s.source, h),
u{k} AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM c{k}),
e{k} AS (SELECT source, min(h) FILTER (WHERE upto > "left") AS edge, min(upto - n) FILTER (WHERE upto > "left") AS before FROM u{k} GROUP BY source),
r{k} AS (
  SELECT p.source, lowest, coalesce(edge, 1::BIGINT << 60) AS edge, largest, "left" - before AS rest
  FROM st{k} p LEFT JOIN e{k} e ON e.source IS NOT DISTINCT FROM p.source),
st{n} AS (SELECT source, rest AS "left", edge AS lowest, floor(rest)::BIGINT AS largest FROM r{k} WHERE rest >= 1),"""

SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM sized GROUP BY source),
lvl AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM src WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, least(3 * source_size, w * max(level) FILTER (WHERE level * w <= 3 * source_size) OVER ()) AS target FROM lvl),
per AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 1 END AS passes FROM goal),
st0 AS (
  SELECT source, target - passes * source_size AS "left", 0::BIGINT AS lowest, 1::BIGINT << 60 AS largest FROM per WHERE source_size > 0 AND passes < 3),""" + "".join(
    _ROUND.format(k=k, n=k + 1) for k in range(ROUNDS)
) + f"""
cuts AS ({" UNION ALL ".join(f"SELECT source, lowest, edge, largest FROM r{k}" for k in range(ROUNDS))}),
again AS (
  SELECT DISTINCT s.source, s.h, s.size FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source AND s.h >= c.lowest AND s.h < c.edge AND s.size <= c.largest)
SELECT doc_id, s.size, p.source_size::BIGINT AS source_size, target, (s.size * (passes + CASE WHEN a.h IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM sized s JOIN per p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN again a ON a.source IS NOT DISTINCT FROM s.source AND a.h = s.h AND a.size = s.size
"""
