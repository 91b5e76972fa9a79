"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations only.

A paragraph is a line, or each run of up to WORDS words of a longer one; its digest is 48 bits of a hash with a 16-bit
check of those. A cell of a sketch is the XOR of the digests that fall on it; each digest falls on one cell in each of
several parts. XOR is its own inverse: subtracting another version's sketch cell by cell leaves the paragraphs in which
the versions differ. Peeling takes the cells whose check holds, which have a single digest, removes those digests from
their other cells, and goes on until all cells are empty. What is recovered are the digests that only one version has; of
which, membership in the set at hand tells. If cells remain, both versions are sketched again, larger: digests are dealt into segments
by hash, each with a sketch of its own; segments that still fail are dealt anew by other hashes with more room. Should
the largest sketch fail, which is a matter of hash collisions, the digests themselves are compared.

Likeness is the Jaccard similarity of the two sets of paragraphs, from the recovered digests and the sizes of the sets.

Defined cases: null text is empty; an empty text has no paragraph and two of them are alike (1.0); repeated paragraphs
count once; the document after the last in descending id is the first; null ids come last; rows of equal id follow
each other by hash of the text; a table of one row is its own next document. Ids are whole
numbers; others are an error (a null where ANSI mode is off). Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

WORDS = 16
#: Parts of a sketch and the bits of the digest that choose a cell within one: 3 x 8 for the fingerprint.
SMALL = (3, 3)
#: Try by try: the shape of a segment's sketch, and the digests of both versions together for each segment.
TRIES = (((3, 2), 4), ((3, 3), 5), ((4, 3), 3))
#: Rows of a bucket of neighbouring ids, and the most buckets there may be.
BUCKET_ROWS, MOST_BUCKETS = 1000, 1 << 16

RUN = r"\S+(?:[^\S\n]+\S+){0,%d}" % (WORDS - 1)


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    checked = lambda x: F.shiftleft(x, 16).bitwiseOR(_check(x))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda x: let(F.shiftrightunsigned(F.xxhash64(x), 16), checked)))


def _check(x: Column) -> Column:
    return F.xxhash64(x).bitwiseAND(0xFFFF)


def _places(key: Column, shape: tuple[int, int], shift: int) -> Column:
    """A bit for each of the cells that a digest falls on."""
    parts, bits = shape
    out = None
    for p in range(parts):
        bit = _bit(F.shiftrightunsigned(key, 16 + shift + p * bits).bitwiseAND((1 << bits) - 1).cast("int") + p * (1 << bits))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _toggle(cells: Column, entries: Column) -> Column:
    """XORs entries (k, m) into the cells that their m names."""
    return F.transform(cells, lambda c, i: F.aggregate(entries, c, lambda a, e: F.when(e["m"].bitwiseAND(_bit(i)) != 0, a.bitwiseXOR(e["k"])).otherwise(a)))


def sketch(keys: Column, shape: tuple[int, int], shift: int = 0) -> Column:
    """The cells of a set of digests; of two sets one after the other: the difference of their sketches."""
    empty = F.array_repeat(F.lit(0).cast("long"), shape[0] << shape[1])
    return let(F.transform(keys, lambda k: F.struct(k.alias("k"), _places(k, shape, shift).alias("m"))), lambda es: _toggle(empty, es))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def peel(cells: Column, shape: tuple[int, int], shift: int = 0, rounds: int = 10) -> Column:
    """struct(found, done): the digests that were recovered, and whether none is left."""
    holds = lambda c: (c != 0) & (_check(F.shiftrightunsigned(c, 16)) == c.bitwiseAND(0xFFFF))
    state = lambda cs, found, stop: F.struct(cs.alias("cells"), found.alias("found"), stop.alias("stop"))
    entries = lambda ks: F.transform(ks, lambda k: F.struct(k.alias("k"), _places(k, shape, shift).alias("m")))

    def step(s, _):
        more = let(
            F.array_distinct(F.filter(s["cells"], holds)),
            lambda ks: F.when(F.size(ks) == 0, state(s["cells"], s["found"], F.lit(True))).otherwise(state(let(entries(ks), lambda es: _toggle(s["cells"], es)), F.concat(s["found"], ks), F.lit(False))),
        )
        return F.when(s["stop"], s).otherwise(more)

    # several digests in one cell may pass for one by chance: it is put in, and taken out again later; what was found an even number of times is not there
    odd = lambda ks: F.filter(F.array_distinct(ks), lambda k: F.size(F.filter(ks, lambda x: x == k)) % 2 == 1)
    once = lambda ks: F.when(F.size(F.array_distinct(ks)) == F.size(ks), ks).otherwise(odd(ks))
    start = state(cells, F.array().cast("array<bigint>"), F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.struct(once(s["found"]).alias("found"), (~F.exists(s["cells"], lambda c: c != 0)).alias("done")))


def _segments(pair: Column, room: int, salt: int) -> Column:
    """Both sides' digests dealt into equal segments by hash, in levels so that the work a digest stays small in long texts: array<struct(a, b)>."""
    need = F.ceil((F.size(pair["a"]) + F.size(pair["b"])) / F.lit(room))
    counts = []
    for most in (16, 64, 1 << 30):
        counts.append(F.greatest(F.least(need, F.lit(most)), F.lit(1)).cast("int"))
        need = F.ceil(need / counts[-1])
    # where each digest goes is hashed once, and then compared with the number of each segment
    marked = lambda keys, n, s: F.transform(keys, lambda k: F.struct(k.alias("k"), F.pmod(F.xxhash64(k, F.lit(s)), n.cast("long")).alias("at")))
    side = lambda es, i: F.transform(F.filter(es, lambda e: e["at"] == i), lambda e: e["k"])

    def deal(p: Column, n: Column, s: int) -> Column:
        both = F.struct(marked(p["a"], n, s).alias("a"), marked(p["b"], n, s).alias("b"))
        parts = let(both, lambda m: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(side(m["a"], i).alias("a"), side(m["b"], i).alias("b"))))
        return F.when(n == 1, F.array(F.struct(p["a"].alias("a"), p["b"].alias("b")))).otherwise(parts)

    def dealt(n: Column) -> Column:
        out = F.array(pair)
        for k in range(3):
            out = F.flatten(F.transform(out, lambda p: deal(p, n[f"n{2 - k}"], 3 * salt + k)))  # noqa: B023
        return out

    return let(F.struct(*[n.alias(f"n{k}") for k, n in enumerate(counts)]), dealt)


def with_differences(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """rows with out: the digests that only one of the columns a and b has.

    Peels the difference of the columns a_cells and b_cells first; what fails is sketched anew in segments, try by try,
    each try in a column of its own, and what fails then is compared digest by digest.
    """
    name = lambda k: f"__{out}_{k}"
    pair = F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    nothing, none = F.array().cast("array<struct<a:array<bigint>,b:array<bigint>>>"), F.array().cast("array<bigint>")
    rows = rows.withColumn(name("first"), peel(subtract(F.col(f"{a}_cells"), F.col(f"{b}_cells")), SMALL))
    rows = rows.withColumn(name("open"), F.when(F.col(name("first"))["done"], nothing).otherwise(F.array(pair)))
    found = [F.when(F.col(name("first"))["done"], F.col(name("first"))["found"]).otherwise(none)]
    for k, (shape, room) in enumerate(TRIES):
        shift = 9 * (k + 1)
        got = lambda p: F.struct(p.alias("p"), peel(sketch(F.concat(p["a"], p["b"]), shape, shift), shape, shift).alias("got"))  # noqa: B023, E731
        rows = rows.withColumn(name(f"segments{k}"), F.flatten(F.transform(F.col(name("open")), lambda p: _segments(p, room, k))))  # noqa: B023
        rows = rows.withColumn(name(f"tried{k}"), F.transform(F.col(name(f"segments{k}")), got))
        rows = rows.withColumn(name("open"), F.transform(F.filter(F.col(name(f"tried{k}")), lambda x: ~x["got"]["done"]), lambda x: x["p"]))
        found.append(F.flatten(F.transform(F.filter(F.col(name(f"tried{k}")), lambda x: x["got"]["done"]), lambda x: x["got"]["found"])))
    found.append(F.flatten(F.transform(F.col(name("open")), lambda p: F.concat(F.array_except(p["a"], p["b"]), F.array_except(p["b"], p["a"])))))
    rows = rows.withColumn(out, F.concat(*found))
    return rows.drop(*[c for c in rows.columns if c.startswith(f"__{out}_")])


def likeness(n_a: Column, n_b: Column, differ: Column) -> Column:
    """Shared digests of all digests, from the sizes of both sets and the number that only one has."""
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - differ) / (n_a + n_b + differ))


def as_text(cells: Column) -> Column:
    """A fingerprint: the cells in hex.

    Digits become small one by one, as lower() builds tables for all of Unicode when it is first used, 2.7 GB of garbage in
    a moment, on which an executor's heap grows for good.
    """
    return reduce(lambda t, d: F.replace(t, F.lit(d), F.lit(d.lower())), "ABCDEF", F.array_join(F.transform(cells, F.hex), "-"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (id, text), with keys and keys_cells, and all three of the next row in descending id, after one shuffle of the texts.

    Quantiles of the ids cut them into buckets of neighbours. The largest id of each bucket is itself a quantile, so
    its row is known from the id alone and goes to the bucket above as well, where it ends the order.
    """
    ids = docs.select("id")
    rows, top = ids.agg(F.count("*"), F.max("id")).first()
    n = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    bounds: list[int] = []
    if n > 1 and top is not None:
        got = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0]
        bounds = [b for b in sorted(set(got)) if b < top]
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if len(bounds) <= 512 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    # binary search: the number of bounds below the id
    below = lambda x: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when((a + s <= len(bounds)) & (F.get(edges, a + s - 1) < x), a + s).otherwise(a)) if bounds else F.lit(0)
    own = F.when(F.col("id").isNull(), F.lit(0)).otherwise(below(F.col("id")))
    head = F.when(F.col("id") == top, F.lit(-1)).when(F.get(edges, F.col("__own")) == F.col("id"), F.col("__own") + 1) if bounds else F.when(F.col("id") == top, F.lit(-1))
    if top is None:
        head = F.lit(-1)
    # -1: the first row of all also comes after the last, in the lowest bucket
    at = F.filter(F.array(F.struct(F.col("__own").alias("bucket"), F.lit(0).alias("copy")), F.struct(F.greatest(F.col("__head"), F.lit(0)).alias("bucket"), F.when(F.col("__head") < 0, 2).otherwise(1).alias("copy"))), lambda x: x["bucket"].isNotNull())
    out = docs.withColumn("__own", own.cast("int")).withColumn("__head", head.cast("int"))
    out = out.withColumn("__at", F.explode(F.when(F.col("__head").isNull(), F.slice(at, 1, 1)).otherwise(at)))
    out = out.select("id", "text", F.col("__at.bucket").alias("bucket"), F.col("__at.copy").alias("copy")).repartition("bucket")
    out = out.withColumn("keys", digests(F.col("text"))).withColumn("keys_cells", sketch(F.col("keys"), SMALL))
    w = Window.partitionBy("bucket").orderBy("copy", F.col("id").desc_nulls_last(), F.xxhash64("text"))
    return out.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("text", "keys", "keys_cells")}).filter("copy = 0")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs for each row.

    Then the digests in which a text differs from its edited text and from the next one: edited_lost and next_lost are
    those that only the text has, edited_gained and next_gained those that only the other has.
    """
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_keys", digests(F.col("edited")))
    rows = rows.withColumn("edited_keys_cells", sketch(F.col("edited_keys"), SMALL))
    for x in ("edited_keys", "next_keys"):
        rows = with_differences(rows, "keys", x, f"{x}_diff")
    size = lambda x: F.size(F.col(x))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("keys_cells")).alias("fingerprint"),
        as_text(F.col("edited_keys_cells")).alias("edited_fingerprint"),
        likeness(size("keys"), size("edited_keys"), size("edited_keys_diff")).alias("near_edited"),
        likeness(size("keys"), size("next_keys"), size("next_keys_diff")).alias("near_next"),
        size("keys").cast("long").alias("n_paragraphs"),
        F.array_intersect("edited_keys_diff", "keys").alias("edited_lost"),
        F.array_except("edited_keys_diff", "keys").alias("edited_gained"),
        F.array_intersect("next_keys_diff", "keys").alias("next_lost"),
        F.array_except("next_keys_diff", "keys").alias("next_gained"),
    )
