"""Spelling: distinct words that no form matches, where they stand, and what might have been meant.

Words are made distinct before they are looked up, so a word that a third of all tokens are is looked up once. The
lookup is a left anti join; Spark broadcasts the lexicon if it is small by its measured size, and sorts otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..tables import dealt


def lookup_keys(word: Column) -> Column:
    """The spellings under which a word may be in a lexicon: as it is, in lower case, and with a lower-case tail."""
    tail = F.concat(F.left(word, F.lit(1)), F.lower(F.substring(word, 2, 1 << 30)))
    upper = word == F.upper(word)
    title = (F.left(word, F.lit(1)) == F.upper(F.left(word, F.lit(1)))) & (F.substring(word, 2, 1 << 30) == F.lower(F.substring(word, 2, 1 << 30)))
    return F.array_distinct(F.when(upper, F.array(word, F.lower(word), tail)).when(title, F.array(word, F.lower(word))).otherwise(F.array(word)))


def unknown(words: DataFrame, forms: DataFrame, word: str = "word") -> DataFrame:
    """The distinct words of which no spelling is a form; ordinals are known.

    Words are read once: their spellings meet the forms in one left join, and are taken together again by word, which
    they are still partitioned by where the forms are broadcast.
    """
    distinct = words.select(word).distinct().filter(~W.is_ordinal(F.col(word)))
    keys = distinct.select(word, F.explode(lookup_keys(F.col(word))).alias("form"))
    met = keys.join(forms.select("form").distinct().withColumn("__known", F.lit(1)), "form", "left")
    return met.groupBy(word).agg(F.max("__known").alias("__known")).filter("__known is null").select(word)


def is_small(forms: DataFrame) -> bool:
    """Whether Spark, by its estimate, would broadcast the forms."""
    state = forms.sparkSession._jsparkSession.sessionState()
    return int(str(forms._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= state.conf().autoBroadcastJoinThreshold()


def misspelled(tokens: DataFrame, forms: DataFrame, word: str = "word", split_chars: str = W.SPLIT_CHARS) -> DataFrame:
    """The tokens whose word is unknown; single marks are not looked at.

    Where the forms are small they go to the tokens, each of whose spellings must meet none of them: tokens are read once
    and stay where they are. Else the unknown ones of the distinct words go to the tokens, by word.
    """
    tokens = tokens.filter(~W.is_split_char(F.col(word), split_chars))
    if is_small(forms):
        known = forms.select(F.col("form").alias("__form")).distinct()
        left = tokens.filter(~W.is_ordinal(F.col(word))).withColumn("__keys", lookup_keys(F.col(word)))
        for k in range(3):
            left = left.join(F.broadcast(known), F.get("__keys", F.lit(k)) == F.col("__form"), "left_anti")
        return left.drop("__keys")
    return tokens.join(unknown(tokens, forms, word), word, "left_semi")


def misspelled_in_turn(tokens: DataFrame, forms: DataFrame, word: str = "word", split_chars: str = W.SPLIT_CHARS) -> DataFrame:
    """As misspelled(), by another plan: distinct words that are no form as they are, then those of which no other spelling is."""
    tokens = tokens.filter(~W.is_split_char(F.col(word), split_chars))
    left, known = tokens.select(word).distinct().filter(~W.is_ordinal(F.col(word))), forms.select("form").distinct()
    for k in range(3):
        left = left.withColumn("form", F.get(lookup_keys(F.col(word)), F.lit(k))).join(known, "form", "left_anti").select(word)
    return tokens.join(left, word, "left_semi")


def candidates(unknown_words: DataFrame, forms: DataFrame, distance: int = 2) -> DataFrame:
    """word, form, distance, rank: all forms within a distance of each unknown word, ranked by distance, then form.

    Blocking keeps this from being a cross join. Cut into three pieces, a word keeps one of them through two edits, moved
    by two characters at most: the join is on that piece, its number and the word's length. Words whose pieces would have
    fewer than two characters would meet a large share of all forms near their length; what two words within two edits
    have in common there is a rest after taking out two characters of either, and the join is on that rest.
    """
    short = 2 * (distance + 1)
    n = F.char_length("word")
    near = _by_piece(unknown_words.filter(n >= short), forms, distance).union(_by_rest(unknown_words.filter(n < short), forms.filter(F.char_length("form") < short + distance), distance))
    near = near.distinct().withColumn("distance", F.levenshtein("word", "form")).filter(F.col("distance").between(1, distance))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("distance", "form")))


def _rests(word: Column, distance: int) -> Column:
    """A word and all that is left of it after taking out up to so many characters."""
    out = F.array(word)
    for _ in range(distance):
        fewer = F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w))))))
        out = F.array_distinct(F.concat(out, fewer))
    return out


def _by_rest(u: DataFrame, forms: DataFrame, distance: int) -> DataFrame:
    """word, form: pairs that have a rest in common."""
    a = u.select("word", F.explode(_rests(F.col("word"), distance)).alias("rest"))
    b = forms.select("form").distinct().select("form", F.explode(_rests(F.col("form"), distance)).alias("rest"))
    return dealt(a, "rest").join(b, "rest").select("word", "form")


def _by_piece(unknown_words: DataFrame, forms: DataFrame, distance: int) -> DataFrame:
    """word, form: pairs that have a piece in common."""
    u = unknown_words.select("word", F.char_length("word").alias("n"))
    pieces = distance + 1
    own = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"substring(word, cast(floor(n * {k} / {pieces}) as int) + 1, cast(floor(n * {k + 1} / {pieces}) as int) - cast(floor(n * {k} / {pieces}) as int))").alias("piece")) for k in range(pieces)])
    u = u.select("word", "n", F.explode(own).alias("x")).select("word", "n", F.col("x.k").alias("k"), F.col("x.piece").alias("piece"))
    f = forms.select("form").distinct().withColumn("m", F.char_length("form"))
    # a form offers, for each word length that it may be near to, the pieces at the places they can have moved to
    offers = f.select("form", "m", F.explode(F.expr(f"sequence(greatest(1, m - {distance}), m + {distance})")).alias("n"))
    offers = offers.select("form", "n", F.explode(F.expr(f"sequence(0, {pieces - 1})")).alias("k"), F.col("m"))
    offers = offers.select("form", "n", "k", F.explode(F.expr(f"sequence(-{distance}, {distance})")).alias("shift"))
    a, b = f"cast(floor(n * k / {pieces}) as int)", f"cast(floor(n * (k + 1) / {pieces}) as int)"
    offers = offers.filter(f"{a} + shift >= 0").select("form", "n", "k", F.expr(f"substring(form, {a} + shift + 1, {b} - {a})").alias("piece")).distinct()
    return dealt(u, "n", "k", "piece").join(offers, ["n", "k", "piece"]).select("word", "form")


def replaced(unknown_words: DataFrame, pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """word, form: forms that come from an unknown word by one of the (src, dst) replacements, at any one place.

    All pieces of a word that are as long as some src meet it by equality.
    """
    sizes = [r[0] for r in pairs.select(F.char_length("src")).distinct().collect()]  # a few: how long replacements are
    pieces = F.expr(f"""flatten(transform(array({', '.join(map(str, sorted(sizes))) or 'cast(null as int)'}),
        n -> transform(filter(sequence(1, greatest(length(word) - n + 1, 1)), i -> i + n - 1 <= length(word)), i -> struct(i, substring(word, i, n) as src))))""")
    hit = unknown_words.select("word", F.explode(pieces).alias("x")).select("word", "x.i", "x.src").join(pairs, "src")
    made = hit.select("word", F.expr("concat(substring(word, 1, i - 1), dst, substring(word, i + length(src)))").alias("form")).distinct()
    return made.join(forms.select("form").distinct(), "form", "left_semi").select("word", "form")


def quirks(found: DataFrame, allow_emojis: bool = True, allow_concatenation: bool = False, allow_dashes: bool = False) -> DataFrame:
    """Findings (word, replacements) that no quirk excuses."""
    w, r = F.col("word"), F.col("replacements")
    if allow_emojis:
        found = found.filter(~W.is_emoji(w))
    if allow_concatenation:
        found = found.filter(~W.is_concatenation(w, r))
    if allow_dashes:
        found = found.filter(~W.is_dashed_elsewhere(w, r))
    return found
