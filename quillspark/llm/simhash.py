"""SimHash near-dedup: a byte-position inverted index with count filtering, then connected components.

A fingerprint has 64 bits, 8 bytes. Two that differ in at most 4 bits differ in at most 4 bytes, so at least 4 of the 8
positional bytes are shared: the guaranteed minimum of matches. Every set of 4 positions contains one of 20 sets of 3
(TRIPLES, the smallest such family), so the index lists each distinct fingerprint under 20 keys of three positional
bytes, and any pair to be found meets under a key. For a pair that meets, shared bytes are tallied; pairs with 4 or
more are kept and verified bit by bit.

Lists may be long where many near copies meet, and all their pairs must not be made. Three steps keep them linear:
equal fingerprints are one node; each node is first compared with the smallest node of each of its lists, and the links
found join nodes into components; after that, only lists that still hold several components are looked at, and
in them only pairs of which one is outside the list's main component. A list of one component, however long, is done.
Where that would still be over MANY pairs (very many small components that share three bytes), the list is dealt into
lists of four shared bytes, one for each further position, where the pairs sought meet as well, as they share a fourth.
No link between different components is lost, so components are those of all links.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; null ids come after all
others and a component of null ids alone has id null; rows that repeat an id are grouped each by its own text. Ids are
whole numbers; others are an error (a null where ANSI mode is off). Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import cut

SEED, SHINGLE, NEAR, SHARED = 42, 4, 4, 4
#: Two groups of positions (0-3, 4-7) do not do; this is Turan's family for 8, 4 and 3: any 4 positions contain one of them.
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def _triples() -> list[tuple[int, int, int]]:
    """All sets of 3 within a group, and of two from one group with one from the next."""
    out = [g for g in _GROUPS if len(g) == 3]
    for i, g in enumerate(_GROUPS):
        out += [tuple(sorted((*two, x))) for two in combinations(g, 2) for x in _GROUPS[(i + 1) % 3]]
    assert all(any(set(t) <= set(four) for t in out) for four in combinations(range(8), 4))
    return sorted(out)


TRIPLES = _triples()
#: Pairs of one list beyond which it is dealt into lists of four bytes.
MANY = 1 << 12


def _hashes(text: str | None) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() and .split() know ASCII alone
    if not words:
        return []
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    h = xxhash.xxh64_intdigest
    starts = [0, *[e + 1 for e in ends]]
    return [h(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=False)]


#: Hashes counted at a time, so that a batch of long texts needs no more memory than one of short ones.
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as a signed number."""
    h = np.array(_hashes(text), dtype=">u8")
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[k : k + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [fingerprint(x.as_py()) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """id, fp and more for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
    return rows.mapInArrow(_batches, ", ".join(["id long", "fp long", *(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])]))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(0xFF)


def _keys(fp: Column) -> Column:
    """One number for each of the lists that a fingerprint is in: the number of the triple, then its three bytes."""
    return F.array(*[reduce(Column.bitwiseOR, (F.shiftleft(_byte(fp, p), 8 * i) for i, p in enumerate(t)), F.lit(k << 24).cast("long")) for k, t in enumerate(TRIPLES)])


def _further(fp: Column, key: Column) -> Column:
    """The keys of the lists of four bytes that a list is dealt into, one for each position that its triple leaves."""
    tagged = [F.shiftleft(F.lit(1 << 3 | p).cast("long"), 8).bitwiseOR(_byte(fp, p)) for p in range(8)]
    left = F.array(*[F.array(*[tagged[p] for p in range(8) if p not in t]) for t in TRIPLES])
    return F.transform(F.get(left, F.shiftrightunsigned(key, 24).cast("int")), lambda x: F.shiftleft(x, 32).bitwiseOR(key))


def _linked(a: Column, b: Column) -> Column:
    """Tallies the positional bytes that both share, then verifies the bits."""
    x = a.bitwiseXOR(b)
    shared = sum(((F.shiftrightunsigned(x, 8 * p).bitwiseAND(0xFF) == 0).cast("int") for p in range(8)), F.lit(0))
    return (shared >= SHARED) & (F.bit_count(x) <= NEAR)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) for each node of edges (a, b), by alternating large and small stars.

    Each round is one table: its two stars are short enough to be one plan, in which Spark shuffles the large star once
    for both of its uses. Nodes that are the smallest of their component have no row.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "star")
    before = None
    while True:  # rounds grow with the logarithm of the longest chain
        # large star: each neighbour above u goes to u's smallest neighbour; small star: those below, and u itself
        low = both(edges).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = edges.join(low, edges["b"] == low["u"]).select("a", F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        seen = Observation()
        small = small.filter("a <> b").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        edges = cut(small, "star")
        state = seen.get["n"], seen.get["sum"]
        if not state[0] or state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _open(index: DataFrame) -> DataFrame:
    """The rows (key, fp, comp) of lists of several components, with main, the largest of those, and pairs, how many have one outside it."""
    parts = index.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top")).filter("parts > 1")
    main = main.select("key", F.col("top.comp").alias("main"), ((F.col("n") - F.col("top.n")) * F.col("n")).alias("pairs"))
    return cut(index.select("key", "fp", "comp").join(main, "key"), "simhash-open")


def groups(nodes: DataFrame) -> DataFrame:
    """The rows of nodes (distinct fingerprints, column fp) with comp, the smallest fingerprint that links lead to."""
    index = cut(nodes.select("fp", F.explode(_keys(F.col("fp"))).alias("key")), "simhash-index")
    lists = index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("pivot")).filter("n > 1").drop("n")
    index = cut(index.join(lists, "key"), "simhash-lists")  # lists of one fingerprint have no pairs
    stars = index.filter("fp <> pivot").filter(_linked(F.col("fp"), F.col("pivot"))).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    comp = components(stars).withColumnRenamed("node", "fp")
    index = _open(index.drop("pivot").join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")))
    hot = index.filter(F.col("pairs") > MANY)
    if not hot.isEmpty():
        index = index.filter(F.col("pairs") <= MANY).unionByName(_open(hot.select("fp", "comp", F.explode(_further(F.col("fp"), F.col("key"))).alias("key"))))
    rest = index.filter("comp <> main").select("key", F.col("fp").alias("a"), F.col("comp").alias("a_comp"))
    pairs = rest.join(index.select("key", F.col("fp").alias("b"), F.col("comp").alias("b_comp")), "key")
    # what links components of the first round is a graph of its own, with a node for each of them
    pairs = pairs.filter((F.col("a_comp") != F.col("b_comp")) & _linked(F.col("a"), F.col("b"))).select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    upper = components(pairs).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    out = nodes.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    return out.join(upper, "comp", "left").withColumn("comp", F.coalesce("top", "comp")).drop("top")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links lead to) for each row of docs."""
    return _grouped(cut(fingerprints(docs, id_col, text_col), "simhash-fps")).select(F.col("id").alias("doc_id"), "fp", "component_id")


def _grouped(fps: DataFrame, *more: str) -> DataFrame:
    """fps with component_id and more of what groups() gives."""
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    labelled = groups(nodes)
    first = labelled.groupBy("comp").agg(F.min("first").alias("component_id"))
    of = cut(labelled.join(first, "comp").select("fp", *more, "component_id"), "simhash-of")
    return fps.join(of, "fp")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, that of the smallest id; the columns of docs.

    Each row is judged by the group of its own text, so an id of several texts may stay with some of them. In a group,
    rows that repeat the id that stays all stay; of a group of null ids alone one row stays.
    """
    fps = cut(fingerprints(docs, "doc_id", "text", _text_hash().alias("h")), "simhash-fps")
    grouped = _grouped(fps, "comp")
    gone = grouped.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    left = lambda rows, away: rows.join(away, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (_text_hash() == F.col("__h")), "left_anti")
    if fps.filter("id is null").isEmpty():
        return left(docs, gone)
    # without an id, a group's row is chosen by its text, and by all columns among those of the same text
    alone = grouped.filter("id is null and component_id is null").select("comp", "h").distinct()
    kept = alone.groupBy("comp").agg(F.min("h").alias("h"))
    away = alone.join(kept, ["comp", "h"], "left_anti").select(F.lit(None).cast("long").alias("__id"), F.col("h").alias("__h"))
    null = F.col("doc_id").cast("long").isNull()
    one = Window.partitionBy("__text").orderBy("__row")
    rows = left(docs.filter(null), gone.union(away)).withColumn("__text", _text_hash()).withColumn("__row", F.xxhash64(*docs.columns))
    rows = rows.withColumn("__nth", F.row_number().over(one)).filter("__nth = 1").select(*docs.columns)
    return left(docs.filter(~null), gone).union(rows)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def brute_force(rows: list[tuple[int, str]]) -> dict[int, tuple[str, int]]:
    """doc_id -> (fingerprint in hex, component_id), all pairs; for tests."""
    fp = {}
    for k, text in rows:
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        fp[k] = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))
    group = {k: k for k in fp}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {k: (f"{fp[k]:016x}", find(k)) for k in ids}
